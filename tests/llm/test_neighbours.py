"""Collision counting against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, at, k=5):
    """The k nearest of row ``at``: (score, id), ties to the smaller id."""
    norm = np.sqrt((x * x).sum(axis=1))
    score = (x * x[at]).sum(axis=1) / (norm * norm[at])
    others = np.delete(np.arange(len(ids)), at)
    first = others[np.lexsort((ids[others], -score[others]))[:k]]
    return [(score[i], ids[i]) for i in first]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    got = found(N.op11_neighbours(spark, f"/root/testdata/{sf}"))
    hit, asked = 0, np.flatnonzero(ids % 50 == 0)
    assert set(got) == set(ids[asked])
    for at in asked:
        rows, true = got[ids[at]], brute(ids, x, at)
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and ids[at] not in [r[1] for r in rows]
        known = {i: s for s, i in brute(ids, x, at, len(ids))}
        assert all(abs(known[r[1]] - r[2]) < 1e-12 for r in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        hit += len({i for _, i in true} & {r[1] for r in rows})
    assert hit / (5 * len(asked)) >= 0.95


def test_needed_collisions():
    p = math.erf(N.HALF / math.sqrt(2))
    n = N.needed(64, 0.98)
    at_least = lambda n: sum(math.comb(64, i) * p**i * (1 - p) ** (64 - i) for i in range(n, 65))
    assert at_least(n) >= 0.98 > at_least(n + 1)


def test_copies_ties_and_near_copies(spark):
    """A third of the rows are one vector; near copies must not hide behind them."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[::3] = x[0]
    x[1::60] = x[1] * rng.uniform(0.5, 2, (10, 1)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = found(N.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0))
    ids, true = np.arange(600), x.astype(float)
    exact = 0
    for q, answer in got.items():
        want = brute(ids, true, q)
        exact += [i for _, i in want] == [r[1] for r in answer]
        if q % 3 == 0:  # the copies, by id
            assert [r[1] for r in answer] == [i for i in range(0, 18, 3) if i != q][:5]
    assert len(got) == 12 and exact >= 10


def test_several_query_broadcasts_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((400, 8)).astype(np.float32))]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = found(N.nearest(frame, F.col("vec_id") % 10 == 0))
    monkeypatch.setattr(N, "QUERIES", 7)
    assert found(N.nearest(frame, F.col("vec_id") % 10 == 0)).keys() == whole.keys()
    x = np.array([r[1] for r in rows])
    hit = sum(len({i for _, i in brute(np.arange(400), x, q)} & {r[1] for r in a}) for q, a in whole.items())
    assert hit / (5 * len(whole)) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, [1.0, 0.0]), (50, None), (100, []), (150, [0.0, 0.0]), (200, [nan, 1.0]), (250, [inf, 1.0]), (300, [None, 1.0]), (350, [1.0, 2.0, 2.0]), (351, [1.0, 2.0, 2.5])]
    rest = [(None, [1.0, 1.0]), (None, [-1.0, 0.0]), (0, [1.0, 0.0]), (1, [1e-30, 1e-30]), (2, [3e38, 3e38])]
    frame = spark.createDataFrame(odd + rest, SCHEMA).selectExpr("*", "1 as _row", "'x' as score", "2 as id", "3 as v")
    rows = N.nearest(frame, F.col("vec_id") % 50 == 0).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id is None, r.vec_id or 0, round(r.score, 9)) for r in rows)
    half = round(math.sqrt(0.5), 9)
    twice = [(0, 1, False, 0, 1.0), (0, 2, False, 1, half), (0, 3, False, 2, half), (0, 4, True, 0, half), (0, 5, True, 0, -1.0)]
    assert got == sorted(twice * 2 + [(350, 1, False, 351, round(10 / 3 / math.sqrt(11.25), 9))])
    assert N.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert N.nearest(frame.filter("vec_id = 1"), F.lit(True)).collect() == []


def test_doubles_of_any_size(spark):
    frame = spark.createDataFrame([(0, [1e300, 1e300]), (1, [1e-300, 0.0]), (2, [5e-324, 5e-324])], "vec_id long, embedding array<double>")
    got = found(N.nearest(frame, F.col("vec_id") == 0))[0]
    assert [(i, round(s, 12)) for _, i, s in got] == [(2, 1.0), (1, round(math.sqrt(0.5), 12))]


def test_working_tables_are_deleted(spark):
    from proofmill.llm.shared import shared_dir

    fs = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    left = lambda: {str(s.getPath()) for s in fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs)}
    before = left()
    N.op11_neighbours(spark, "/root/testdata/sf0.001").collect()
    assert len(left() - before) == 1  # the result
