"""Connected components of an edge table by alternating large and small stars.

Each round is two groupings with a partial minimum and two joins; its edges are
written to the shared folder. The number of rounds grows with the logarithm of
the longest path. Before the first round, tasks replace their own edges by a
spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm import memo
from proofmill.llm.shared import written


class Union:
    """Union-find over hashable names; the root is the least name."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (y := up.setdefault(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up[x]
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


@memo.task()
def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of one task as stars, in rounds of a bounded number of edges."""
    union, n = Union(), 0

    def stars() -> pa.RecordBatch:
        pairs = [(x, union.find(x)) for x in list(union.up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.record_batch({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            union.join(a, b)
        n += batch.num_rows
        if len(union.up) > 1_000_000:
            yield stars()
            union = Union()
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node reachable) of every node that has an edge."""
    pairs = written(edges.select("a", "b").mapInArrow(forest, "a long, b long"), "edges")
    before = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # after a large star, a > b in every edge
        large = written(large, "edges", pairs)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        pairs = written(small, "edges", large)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)
