"""Nearest neighbours by cosine: collision counting over sorted projections.

Vectors are scaled to length 1, so the nearest by distance are the nearest by cosine.
Rows are dealt into blocks; a block keeps, for each of ``PROJECTIONS`` random directions,
its vectors in the order of their projections. A query opens a window around its own
projection in each of these arrays. The windows grow with the radius (virtual rehashing:
the arrays stay, only the window's ends move), and a row's collisions are the windows
that have reached it. Rows with ``needed()`` collisions or more are verified by their
exact cosine. A query stops at a radius that reaches its k-th verified row: a row within
that radius has been verified with probability ``CERTAIN`` at least, whatever the data,
so that is the expected recall. The last radius has no end, so that a query finds k rows
wherever there are as many. No number of candidates is capped.

Queries go out in broadcasts of ``QUERIES`` rows, one pass over the rows for each, so
neither the driver nor a task holds more than one such block of them.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part. Vectors of different lengths are never compared. Rows that repeat, or share
an id, are rows of their own: each is a query if the others are, and a candidate for the
others. Ties go to the smaller id, null ids last. Columns besides the two named ones are
not read, so their names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.llm import memo
from proofmill.llm.shared import drop_written, scratch, table, written

K = 5
PROJECTIONS = 64
#: Half the width of a window at radius 1.
HALF = 1.36
CERTAIN = 0.98
#: Radii of the windows; the last one has no end.
RADII = (0.25, 0.5, 0.75, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.7, 2.0, math.inf)
BLOCK_BYTES = 8 << 20  # of a block's vectors as doubles
QUERIES = 20_000  # of a broadcast
CHUNK = 128  # queries whose windows are worked out at once
SEED = 11
SLACK = 1e-9  # more than rounding does to a cosine


def needed(projections: int = PROJECTIONS, certain: float = CERTAIN) -> int:
    """The most collisions to ask for, if a row at the radius itself is to have them with probability ``certain``."""
    p = math.erf(HALF / math.sqrt(2))
    at_least = 0.0
    for n in range(projections, 0, -1):
        at_least += math.comb(projections, n) * p**n * (1 - p) ** (projections - n)
        if at_least >= certain:
            return n
    return 1


def directions(width: int) -> np.ndarray:
    """The random directions of vectors of ``width`` components, the same in every task."""
    return np.random.default_rng([SEED, width]).standard_normal((width, PROJECTIONS))


class Vectors:
    """Vectors of one length: row numbers, ids (and which are null), components scaled by powers of two, lengths."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, absent: np.ndarray, raw: np.ndarray):
        _, exponent = np.frexp(np.abs(raw).max(axis=1))
        self.rows, self.ids, self.absent = rows, ids, absent
        self.raw = np.ldexp(raw, -exponent[:, None])  # exact, and squares stay in range
        self.norm = np.sqrt((self.raw * self.raw).sum(axis=1))
        self.unit = self.raw / self.norm[:, None]


def by_width(batch: pa.RecordBatch | pa.Table) -> dict[int, Vectors]:
    """Rows (_row, id, v) as ``Vectors`` of each length."""
    if isinstance(batch, pa.Table):
        batch = batch.combine_chunks()
    column = lambda name: c.combine_chunks() if isinstance(c := batch.column(name), pa.ChunkedArray) else c
    rows, ids, v = column("_row").to_numpy(zero_copy_only=False), column("id"), column("v")
    absent = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    flat, offsets = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))])
    widths = np.diff(offsets)
    out = {}
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        out[w] = Vectors(rows[at], ids[at], absent[at], flat[offsets[at][:, None] + np.arange(w)])
    return out


class Best:
    """The k best rows found so far of each of some queries."""

    def __init__(self, n: int, k: int):
        self.k, self.kept = k, [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool))] * n

    def worst(self, q: int) -> float:
        """The k-th best cosine of query q, less than any cosine if it has fewer rows."""
        score = self.kept[q][0]
        return float(score[-1]) if len(score) == self.k else -2.0

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        s, i, a = (np.concatenate(x) for x in zip(self.kept[q], (score, ids, absent), strict=True))
        first = np.lexsort((i, a, -s))[: self.k]
        self.kept[q] = s[first], i[first], a[first]


class Block:
    """The sorted arrays of one block of vectors."""

    def __init__(self, vectors: Vectors):
        self.v = vectors
        along = np.ascontiguousarray((vectors.unit @ directions(vectors.unit.shape[1])).T)
        self.order = np.argsort(along, axis=1, kind="stable")
        self.sorted = np.take_along_axis(along, self.order, axis=1)

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of the windows, by query, radius and projection; before them, the query's own place twice."""
        half = HALF * np.array((0.0, *RADII))
        centre = queries @ directions(queries.shape[1])
        low = np.empty((len(queries), len(half), PROJECTIONS), np.int64)
        high = np.empty_like(low)
        for p in range(PROJECTIONS):
            low[:, :, p] = np.searchsorted(self.sorted[p], centre[:, p, None] - half)
            high[:, 1:, p] = np.searchsorted(self.sorted[p], centre[:, p, None] + half[1:], "right")
        high[:, 0] = low[:, 0]
        return low, high

    def search(self, queries: Vectors, best: Best, least: int) -> None:
        for at in range(0, len(queries.rows), CHUNK):
            low, high = self.windows(queries.unit[at : at + CHUNK])
            for q in range(len(low)):
                self._one(queries, at + q, low[q], high[q], best, least)

    def _one(self, queries: Vectors, q: int, low: np.ndarray, high: np.ndarray, best: Best, least: int) -> None:
        n = len(self.v.rows)
        hits, done = np.zeros(n, np.int64), self.v.rows == queries.rows[q]  # a row is no neighbour of its own
        for step, radius in enumerate(RADII, 1):
            ends = zip(self.order, low[step].tolist(), low[step - 1].tolist(), high[step - 1].tolist(), high[step].tolist(), strict=True)
            grown = np.concatenate([x for o, a, b, c, d in ends for x in (o[a:b], o[c:d])])
            if len(grown):
                hits += np.bincount(grown, minlength=n)
                self._verify(queries, q, np.flatnonzero((hits >= least) & ~done), best)
                done |= hits >= least
            # a cosine of 1 - r * r / 2 is a distance of r
            if best.worst(q) >= 1 - radius * radius / 2:
                return

    def _verify(self, queries: Vectors, q: int, found: np.ndarray, best: Best) -> None:
        """The exact cosines of the rows that may be among the k best."""
        near = self.v.unit[found] @ queries.unit[q]
        bar = best.worst(q)
        if len(near) > best.k:
            bar = max(bar, float(np.partition(near, -best.k)[-best.k]))
        found = found[near >= bar - SLACK]
        if len(found):
            score = (self.v.raw[found] * queries.raw[q]).sum(axis=1) / (self.v.norm[found] * queries.norm[q])
            best.add(q, score, self.v.ids[found], self.v.absent[found])


def _searched(shipped, k: int, least: int):
    @memo.task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, Vectors] = shipped.value
        best = {w: Best(len(q.rows), k) for w, q in queries.items()}
        held, size = [], 0

        def index() -> None:
            for w, vectors in by_width(pa.Table.from_batches(held)).items():
                if w in queries:
                    Block(vectors).search(queries[w], best[w], least)

        for batch in batches:
            for at in range(0, batch.num_rows, step := max(1, BLOCK_BYTES * batch.num_rows // max(1, batch.nbytes))):
                part = batch.slice(at, step)
                if held and size + part.nbytes > BLOCK_BYTES:
                    index()
                    held, size = [], 0
                held.append(part)
                size += part.nbytes
        if held:
            index()
        for w, q in queries.items():
            for i, (score, ids, absent) in enumerate(best[w].kept):
                if len(score):
                    n = len(score)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, q.rows[i])), pa.array(np.full(n, q.ids[i])), pa.array(ids, mask=absent), pa.array(score)], ["_query", "query_id", "vec_id", "score"])

    return run


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    return F.coalesce(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, id_: str = "vec_id", v: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows, other than itself, of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    narrow = vectors.select(F.col(id_).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("_asks"))
    # row numbers are written down: they must not change when a task runs again
    rows = written(narrow.filter(usable(F.col("v"))).withColumn("_row", F.monotonically_increasing_id()), "vectors")
    total = rows.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("size"), F.count_if("_asks").alias("asks")).first()
    passes = -(-total.asks // QUERIES)
    block = max(1, BLOCK_BYTES // (8 * max(1, (total["size"] or 0) // max(1, total.n))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total.n // (8 * block)))
    # a number given keeps small tables from being put together in one task
    dealt = rows.select("_row", "id", "v").repartition(parts, "_row")
    path, best = scratch(spark, "nearest"), Window.partitionBy("_query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    schema = "_query long, query_id long, vec_id long, score double"
    for at in range(passes):
        asked = by_width(rows.filter("_asks").filter(F.pmod(F.xxhash64("_row"), F.lit(passes)) == at).select("_row", "id", "v").toArrow())
        shipped = spark.sparkContext.broadcast(asked)
        found = dealt.mapInArrow(_searched(shipped, k, needed()), schema)
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        shipped.destroy()
    drop_written(spark, rows)
    result = "query_id long, rank int, vec_id long, score double"
    return spark.read.schema(result).parquet(path) if passes else spark.createDataFrame([], result)


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every row whose vec_id is divisible by 50, against all rows."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
