"""Candidates of whole sessions against the scores of all pairs."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import claims

from proofmill.operators import candidates, pairs

SUBJECTS = ["Apple Inc.", "Apple", "apple", "Microsoft Corporation", "Microsoft", "Tesla Motors", "Alpine Ltd", "", None, "---", "İzmir A.Ş.", "The of and", "net sales"]
PREDICATES = ["revenue", "net sales", "total revenue", "cash balance", "operating profit", "headcount increase", "", None, "profit due to growth"]
DEFINITIONS = [None, None, None, "", "order value gross", "order value net", "before tax", "a because of", "??"]


def some(spark, n, seed, sessions=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        year = rng.choice([2021, 2022, None])
        rows.append(
            {
                "id": rng.choice([str(i), str(i), str(i), None, "0"]),
                "session_id": rng.choice([f"s{k}" for k in range(sessions)]),
                "document_id": rng.choice(["d1", "d2", "d3", "", None]),
                "subject": rng.choice(SUBJECTS),
                "predicate": rng.choice(PREDICATES),
                "definition": rng.choice(DEFINITIONS),
                "basis": rng.choice([None, "GAAP", "Non-GAAP"]),
                "scope": rng.choice([None, None, "Cloud segment", "Total company"]),
                "period_start": year and f"{year}-01-01",
                "period_type": rng.choice([None, "FY", "fy"]),
                "unit": rng.choice([None, "", "billion USD", "₹ crore", "percent", "times", "widgets"]),
                "value_type": rng.choice([None, "numeric", "Numeric ", "text"]),
            }
        )
    return pairs.ordered(claims(spark, *rows))


def all_scores(table):
    rows = pairs.pair_scores(pairs.enumerate_pairs(pairs.prepared(table))).filter("score > 0")
    return {(r.session_id, r.o, r.p): (r.score, r.reason, r.x, r.y) for r in rows.select("session_id", F.col("a.ord").alias("o"), F.col("b.ord").alias("p"), "score", "reason", F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()}


@pytest.mark.parametrize("block, strip, few", [(1024, 256, 1024), (7, 3, 0), (16, 16, 20)])
def test_whole_sessions_equal_all_pairs(spark, monkeypatch, block, strip, few):
    table = some(spark, 90, block).cache()
    want = all_scores(table)
    assert len(want) > 300
    # the functions are sent to workers by name, so the module's sizes go with the plan only here
    monkeypatch.setattr(candidates, "BLOCK", block)
    got = candidates.scored(table).collect()
    assert {(r.session_id, r.ord_a, r.ord_b): (r.score, r.reason, r.id_a, r.id_b) for r in got} == want and len(got) == len(want)
    found = candidates.find(table).collect()
    assert {(r.session_id, r.ord_a, r.ord_b) for r in found} == set(want) and len(found) == len(want)
    for top in (1, 10, 10_000):
        ranked = {}
        for (s, a, b), (score, *_) in want.items():
            ranked.setdefault(s, []).append((-score, a, b))
        ranked = {(s, a, b): k for s, rows in ranked.items() for k, (_, a, b) in enumerate(sorted(rows)[:top], 1)}
        assert {(r.session_id, r.ord_a, r.ord_b): r["rank"] for r in candidates.best(table, top).collect()} == ranked


@pytest.mark.parametrize("strip, few", [(3, 0), (40, 100)])
def test_strips_equal_all_pairs(spark, monkeypatch, strip, few):
    """The same inside one process, with small strips and no ratios before the bounds."""
    import pyarrow as pa

    table = some(spark, 60, 5, 1)
    want = {k[1:]: v[:2] for k, v in all_scores(table).items()}
    monkeypatch.setattr(candidates, "STRIP", strip)
    monkeypatch.setattr(candidates, "FEW", few)
    rows = candidates.narrow(table).withColumn("side", F.lit(0)).toArrow()
    key = (pa.scalar("s0"), pa.scalar(0), pa.scalar(0))
    got = candidates._met(candidates._scores)(key, rows).to_pylist()
    assert {(r["ord_a"], r["ord_b"]): (r["score"], r["reason"]) for r in got} == want
    halves = rows.set_column(rows.schema.get_field_index("side"), "side", pa.array([k % 2 for k in range(rows.num_rows)]))
    across = candidates._met(candidates._candidates)((pa.scalar("s0"), pa.scalar(0), pa.scalar(1)), halves).to_pylist()
    ords = rows.column("ord").to_pylist()
    side = {o: k % 2 for k, o in enumerate(ords)}
    assert {(r["ord_a"], r["ord_b"]) for r in across} == {(a, b) for a, b in want if side[a] != side[b]}


def test_few_pairs_get_a_ratio(spark, monkeypatch):
    """The best pairs of a session: bounds decide nearly all of its pairs."""
    from proofmill.functions import matching

    asked, whole = [], matching.ratios
    monkeypatch.setattr(matching, "ratios", lambda x, y: (asked.append(len(x)), whole(x, y))[1])
    table = some(spark, 400, 9, 1)
    rows = candidates.narrow(table).withColumn("side", F.lit(0)).toArrow()
    import pyarrow as pa

    got = candidates._met(candidates._best(150))((pa.scalar("s0"), pa.scalar(0), pa.scalar(0)), rows)
    assert got.num_rows >= 150 and sum(asked) < 0.05 * 400 * 399 / 2


def test_empty(spark):
    none = some(spark, 5, 1).limit(0)
    assert candidates.find(none).count() == candidates.best(none).count() == 0
    assert candidates.find(some(spark, 1, 1)).count() == 0


def test_every_pair_has_its_score(spark):
    table = some(spark, 60, 9).cache()
    plain = pairs.pair_scores(pairs.enumerate_pairs(pairs.prepared(table))).select("session_id", F.col("a.ord"), F.col("b.ord"), "score", "reason").collect()
    got = candidates.every(table).select("session_id", "ord_a", "ord_b", "score", "reason").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain))
    assert {r.reason for r in got} >= {"same_claim", "below_threshold", "same_subject_and_predicate"}
