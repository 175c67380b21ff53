"""Range shards of near-equal bytes by sampled splitters.

Rows are ordered by the hash of their text. A sample in which each row's chance
grows with its size gives the keys at equal shares of the bytes; these split the
order into many small ranges. The true size of each range is then summed over all
rows, and an overfull range is divided by a second hash of the text into parts, so
equal texts stay together. Only a text whose copies outweigh a shard is divided, by
a hash of its rows. Whole parts go to shards, largest first, to the lightest shard
(evenness decides, not the order of the ranges). Slots are numbered in cells: parts
with many rows are cut into cells for that, which doesn't move them.

Null and empty texts have size 1 and share a part. Equal rows get different slots.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.llm.shared import table, written

SHARDS = 8
RANGES = 2048
PER_RANGE = 16  # sampled keys
ROWS_PER_RANGE = 1_000_000
MOST_RANGES = 65_536
PREFIX_BITS = 12


def place_units(units: list[tuple[int, object]], shards: int) -> dict:
    """Units (size, name) to shards, largest first, each to the lightest."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(units, key=lambda u: (-u[0], str(u[1]))):
        load, s = heapq.heappop(heap)
        out[name] = s
        heapq.heappush(heap, (load + size, s))
    return out


def range_shards(rows: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """Add shard and slot to rows that have h (the order's key), tie (a second hash) and size; both added columns are whole."""
    spark = rows.sparkSession
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = min(MOST_RANGES, max(ranges, n // ROWS_PER_RANGE))
    step = max(1.0, total / (ranges * PER_RANGE))
    # a row of size s is drawn s / step times on average: once for each multiple of step that its own stretch covers
    chance = F.pmod(F.xxhash64("h", "tie", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(F.col("size") / F.lit(step) + chance).cast("int")
    drawn = rows.select("h", times.alias("times")).filter("times > 0").groupBy("h").agg(F.sum("times").alias("times"))
    keys, seen = [], 0
    for r in drawn.orderBy("h").collect():  # at most about ranges * PER_RANGE keys
        if seen // PER_RANGE != (seen + r.times) // PER_RANGE:
            keys.append(r.h)
        seen += r.times
    # the splitters below a key: those under its prefix, counted ahead, and those within it
    by_prefix: dict[int, list[int]] = {}
    for k in keys:
        by_prefix.setdefault(k >> (64 - PREFIX_BITS), []).append(k)
    rank, prefixes = 0, []
    for p in range(-(1 << (PREFIX_BITS - 1)), 1 << (PREFIX_BITS - 1)):
        inside = by_prefix.get(p, [])
        prefixes.append((p, rank, inside))
        rank += len(inside)
    found = spark.createDataFrame(prefixes, "prefix long, below int, inside array<long>")
    ranged = (
        rows.withColumn("prefix", F.shiftright("h", 64 - PREFIX_BITS))
        .join(F.broadcast(found), "prefix")
        .withColumn("range", F.col("below") + F.size(F.filter("inside", lambda x: x < F.col("h"))))
        .drop("prefix", "below", "inside")
    )
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row per range
    target, shard = max(1.0, total / ranges), total / shards
    # parts: an overfull range is divided by a second hash of the text
    parts = {r.range: max(1, round(r["size"] / target)) for r in sizes if r["size"] > 2 * target}
    parted = _looked_up(ranged, [(k, v) for k, v in parts.items() if v > 1], "range int, parts int", ["range"])
    parted = parted.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("h", F.lit("part")), F.col("parts"))).otherwise(0).cast("int")).drop("parts")
    counted = parted.groupBy("range", "part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # about a row per range
    # texts whose copies outweigh a shard lie in parts that do; there are fewer of them than shards
    heavy = _looked_up(parted, [(r.range, r.part, True) for r in counted if r["size"] > shard], "range int, part int, heavy boolean", ["range", "part"]).filter("heavy")
    hot = {r.h: (r["size"], r.n) for r in heavy.groupBy("h").agg(F.sum("size").alias("size"), F.count("*").alias("n")).filter(F.col("size") > shard).collect()} if any(r["size"] > shard for r in counted) else {}
    # cells: parts with many rows are cut by a hash of the row, for the numbering of slots
    even = max(1, n // ranges)
    marked = parted.withColumn("hot", F.col("h").isin(list(hot)) if hot else F.lit(False))
    rows_of = marked.groupBy("range", "part", "hot").agg(F.count("*").alias("n")).collect()
    many = [(r.range, r.part, r.hot, -(-r.n // even)) for r in rows_of if r.n > 2 * even]
    celled = _looked_up(marked, many, "range int, part int, hot boolean, cells int", ["range", "part", "hot"])
    celled = celled.withColumn("cell", F.when(F.col("cells") > 1, F.pmod("tie", F.col("cells"))).otherwise(0).cast("int")).drop("cells")
    cell = ["range", "part", "hot", "cell"]
    cells = [(*(r[c] for c in cell), r["size"], r.n) for r in celled.groupBy(*cell).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()]  # a few rows per range
    units: dict[tuple, int] = {}
    for *name, size, _ in cells:
        unit = tuple(name) if name[2] else tuple(name[:2])
        units[unit] = units.get(unit, 0) + size
    placed = place_units([(size, unit) for unit, size in units.items()], shards)
    base, where = [0] * shards, []
    for *name, _, count in sorted(cells):
        s = placed[tuple(name) if name[2] else tuple(name[:2])]
        where.append((*name, s, base[s]))
        base[s] += count
    cell_table = spark.createDataFrame(where, "range int, part int, hot boolean, cell int, shard int, base long")
    order = Window.partitionBy(*cell).orderBy("h", "tie", *[c for c in rows.columns if c not in ("h", "tie")])
    return celled.join(F.broadcast(cell_table), cell).withColumn("slot", F.col("base") + F.row_number().over(order) - 1).drop(*cell, "base")


def _looked_up(rows: DataFrame, found: list[tuple], schema: str, keys: list[str]) -> DataFrame:
    """Left join with a table of at most a few rows per range."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(found, schema)), keys, "left")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64("doc_id", F.lit("tie")).alias("tie"),
    )
    return range_shards(written(rows, "shard-rows")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
