"""Working folders that every executor sees, and lineage cuts by written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
_local: list[str] = []
_made: list[str] = []  # working folders of this session, in order


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _local[0]


def scratch(spark: SparkSession, name: str, kept: bool = False) -> str:
    """A new working folder's path. ``kept``: tasks read its files by path, so ``tidied`` can't see it in a plan and leaves it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not kept:
        _made.append(path)
    return path


def written(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors then cost no recomputation.

    The folders of ``done``, earlier tables of this kind that only ``df`` was made from, are deleted then.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    for x in done:
        drop_written(spark, x)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many working folders there have been."""
    return len(_made)


def tidied(result: DataFrame, since: int) -> DataFrame:
    """``result``, after the working folders made after ``since`` that it doesn't read are deleted."""
    spark = result.sparkSession
    read = {f.rsplit("/", 2)[-2] for f in result.inputFiles()}
    for path in _made[since:]:
        if path.rsplit("/", 1)[-1] not in read:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return result


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Delete the folder behind a table of ``written`` that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder. Texts go to Python in batches of a few MB, unless the session says otherwise."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows, by counting at most one more."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` where a count proves it small; leave the join strategy to Spark where not."""
    return F.broadcast(df) if at_most(df, rows) else df
