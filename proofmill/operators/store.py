"""Ledger tables as versions in a folder; rows are added and deleted without rewriting others."""

from __future__ import annotations

import re
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.sources.schemas import TABLES


class Conflict(RuntimeError):
    """Another writer changed the table in between."""


_commit = threading.Lock()


class Ledger:
    """Tables under one folder that every executor sees.

    A version is a folder: ``v<n>`` holds the whole table, ``v<n>a`` rows added to what is before,
    ``v<n>d.<column>`` values of a column whose rows before it are deleted. A version counts when it is
    whole, and old ones stay readable. Rows are written aside first; a version's number is taken by
    creating a file that mustn't exist, so two writers never write one version. Added rows may be
    parted into buckets, folders of their own, so that a reader of few buckets opens no other file.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _versions(self, name: str) -> list[tuple[int, str]]:
        """Number and kind of each whole version: empty for a whole table, ``a``, or ``d.<column>``."""
        at = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(at):
            return []
        found = [s.getPath() for s in self._fs.listStatus(at)]
        names = [p.getName()[1:] for p in found if self._fs.exists(self._path(f"{p}/_SUCCESS"))]
        return sorted((int(m[1]), m[2]) for m in (re.fullmatch(r"(\d+)(|a|d\..+)", n) for n in names) if m)

    def version(self, name: str) -> int:
        """The newest whole version, 0 if there is none."""
        return max((n for n, _ in self._versions(name)), default=0)

    def _folders(self, name: str, version: str, buckets: set[int] | None) -> list[str]:
        """The folders of a version's rows: those of the buckets, if it has any."""
        path = f"{self.folder}/{name}/v{version}"
        if buckets is None:
            return [path]
        parts = [s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory()]
        wanted = {f"_b={b}" for b in buckets}
        # rows without a bucket lie in a folder whose name is no number
        return [f"{path}/{p}" for p in parts if p in wanted or not re.fullmatch(r"_b=-?\d+", p)] if parts else [path]

    def read(self, name: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The table as of ``version`` (None: the newest); only the given buckets, and rows that were added without one."""
        return self._rows(name, version, buckets).drop("_b")

    def _rows(self, name: str, version: int | None, buckets: set[int] | None) -> DataFrame:
        """The table with ``_b``, each row's bucket."""
        known = [v for v in self._versions(name) if version is None or v[0] <= version]
        whole = max((n for n, kind in known if not kind), default=0)
        held = [f for n, kind in known if n >= whole and kind in ("", "a") for f in self._folders(name, f"{n}{kind}", buckets)]
        if not held:
            return self.spark.createDataFrame([], TABLES[name]).withColumn("_b", F.lit(None).cast("int"))
        rows = self.spark.read.schema(TABLES[name]).option("recursiveFileLookup", True).parquet(*held).withColumn("_b", F.nullif(F.regexp_extract("_metadata.file_path", r"/_b=(-?\d+)/", 1), F.lit("")).cast("int"))
        gone: dict[str, list[str]] = {}
        for n, kind in known:
            if n > whole and kind.startswith("d."):
                gone.setdefault(kind[2:], []).append(f"{self.folder}/{name}/v{n}{kind}")
        if not gone:
            return rows
        number = F.regexp_extract("_metadata.file_path", rf"/{name}/v(\d+)", 1).cast("int")
        rows = rows.withColumn("_v", number)
        for column, paths in gone.items():
            dead = self.spark.read.schema("value string").parquet(*paths).withColumn("_d", number).groupBy("value").agg(F.max("_d").alias("_d"))
            rows = rows.join(dead, (rows[column] == dead["value"]) & (dead["_d"] > rows["_v"]), "left_anti")
        return rows.drop("_v")

    def changes(self, name: str, since: int) -> list[tuple[int, str]]:
        """Number and kind of the versions after ``since``."""
        return [v for v in self._versions(name) if v[0] > since]

    def added(self, name: str, n: int, kind: str) -> DataFrame:
        """The rows of one version of kind ``a``."""
        return self.spark.read.schema(TABLES[name]).option("recursiveFileLookup", True).parquet(f"{self.folder}/{name}/v{n}{kind}")

    def removed(self, name: str, n: int, kind: str) -> DataFrame:
        """The rows that a version of kind ``d.<column>`` deleted."""
        dead = self.spark.read.schema("value string").parquet(f"{self.folder}/{name}/v{n}{kind}")
        return self.read(name, n - 1).join(dead.withColumnRenamed("value", kind[2:]), kind[2:], "left_semi")

    def history(self, name: str) -> DataFrame:
        """All rows that any version still there holds, deleted ones too; a row may come more than once."""
        held = [f"{self.folder}/{name}/v{n}{kind}" for n, kind in self._versions(name) if kind in ("", "a")]
        return self.spark.read.schema(TABLES[name]).option("recursiveFileLookup", True).parquet(*held) if held else self.spark.createDataFrame([], TABLES[name])

    def _taken(self, name: str, n: int) -> bool:
        """Take the number of a version: create a file that mustn't exist."""
        path = self._path(f"{self.folder}/_commits/{name}.{n}")
        with _commit:  # a local file system looks before it creates, which another thread could use
            if self._fs.exists(path):
                return False
            try:
                self._fs.create(path, False).close()
            except Py4JJavaError:
                if self._fs.exists(path):
                    return False
                raise
        return True

    def _save(self, name: str, rows: DataFrame, kind: str, expected: int | None = None, bucket: str | None = None) -> int:
        """Write rows aside, take a number and move them there. With ``expected`` the version must follow that one."""
        aside = f"{self.folder}/_aside/{uuid.uuid4().hex}"
        (rows.write.partitionBy(bucket) if bucket else rows.write).parquet(aside)
        n = (self.version(name) if expected is None else expected) + 1
        while not self._taken(name, n):
            if expected is not None:
                self._fs.delete(self._path(aside), True)
                raise Conflict(f"{name} is past version {expected}")
            n += 1
        self._fs.mkdirs(self._path(f"{self.folder}/{name}"))
        if not self._fs.rename(self._path(aside), self._path(f"{self.folder}/{name}/v{n}{kind}")):
            raise OSError(f"version {n} of {name} could not be moved to its place")
        return n

    def _shaped(self, name: str, rows: DataFrame, *more: str) -> DataFrame:
        fields, have = TABLES[name].fields, set(rows.columns)
        return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in fields), *more)

    def write(self, name: str, rows: DataFrame, expected: int | None = None) -> int:
        """Replace the table; with ``expected`` only if no one has changed it since that version."""
        return self._save(name, self._shaped(name, rows), "", self.version(name) if expected is None else expected)

    def append(self, name: str, rows: DataFrame, bucket: str | None = None, expected: int | None = None) -> int:
        """Add rows, parted by the integer column ``bucket`` if it is given; what is stored isn't read or written again."""
        if bucket is None:
            return self._save(name, self._shaped(name, rows), "a", expected)
        return self._save(name, self._shaped(name, rows.withColumn("_b", F.col(bucket)), "_b"), "a", expected, "_b")

    def delete(self, name: str, column: str, values: DataFrame) -> int:
        """Delete the rows whose ``column`` is one of ``values`` (one column); no stored row is written again."""
        return self._save(name, values.toDF("value").filter("value is not null").distinct(), f"d.{column}")

    def delete_documents(self, ids: DataFrame) -> None:
        """Delete documents (id) and what hangs on them; what refers goes before what it refers to."""
        gone = ids.select(F.col("id").alias("document_id")).distinct()
        dead = self.read("claims").join(gone, "document_id", "left_semi").select("id")
        for name, column, values in (("relationships", "source_claim_id", dead), ("relationships", "target_claim_id", dead), ("claims", "document_id", gone), ("evidence_blocks", "document_id", gone), ("documents", "id", gone)):
            self.delete(name, column, values)

    def delete_session(self, session_id: str) -> None:
        self.delete_documents(self.read("documents").filter(F.col("session_id") == session_id))
        self.delete("sessions", "id", self.spark.createDataFrame([(session_id,)], "id string"))

    def compact(self, name: str, versions: int = 20) -> bool:
        """Write the table whole, in its buckets, if its last whole version has more than ``versions`` after it. ``Conflict`` if someone else writes meanwhile."""
        known = self._versions(name)
        whole = max((n for n, kind in known if not kind), default=0)
        if sum(n > whole for n, _ in known) <= versions:
            return False
        now = known[-1][0]
        bucketed = any(s.isDirectory() for n, kind in known if kind in ("", "a") and n >= whole for s in self._fs.listStatus(self._path(f"{self.folder}/{name}/v{n}{kind}")))
        self._save(name, self._shaped(name, self._rows(name, now, None), *(["_b"] if bucketed else [])), "", now, "_b" if bucketed else None)
        return True

    def forget(self, name: str, before: int) -> None:
        """Delete the folders of versions that no read from version ``before`` on needs."""
        known = self._versions(name)
        whole = max((n for n, kind in known if not kind and n <= before), default=0)
        for n, kind in known:
            if n < whole:
                self._fs.delete(self._path(f"{self.folder}/{name}/v{n}{kind}"), True)


def first_seen(claims: DataFrame) -> DataFrame:
    """The registry of predicates: the document and definition of each one's first claim."""
    return claims.groupBy("predicate").agg(F.min_by(F.struct("document_id", "definition"), F.struct("created_at", "id")).alias("x")).select("predicate", F.col("x.document_id").alias("first_seen_document_id"), F.col("x.definition").alias("example_definition"))


def set_status(documents: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    hit = ids.select(F.col("id"), F.lit(True).alias("_hit")).distinct()
    return documents.join(hit, "id", "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit")


def without_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after the documents in ``gone`` (id) and what hangs on them are deleted."""
    gone = gone.select(F.col("id").alias("document_id")).distinct()
    claims = tables["claims"].join(gone, "document_id", "left_anti")
    dead = tables["claims"].join(gone, "document_id", "left_semi").select("id")
    related = tables["relationships"]
    for side in ("source_claim_id", "target_claim_id"):
        related = related.join(dead.select(F.col("id").alias(side)), side, "left_anti")
    return tables | {
        "relationships": related,
        "claims": claims,
        "evidence_blocks": tables["evidence_blocks"].join(gone, "document_id", "left_anti"),
        "documents": tables["documents"].join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti"),
    }


def without_session(tables: dict[str, DataFrame], session_id: str) -> dict[str, DataFrame]:
    out = without_documents(tables, tables["documents"].filter(F.col("session_id") == session_id))
    return out | {"sessions": tables["sessions"].filter(F.col("id") != session_id)}


def rate_window(requests: DataFrame, partition: str, at: str, tokens: str) -> DataFrame:
    """Requests and tokens in the 60 seconds up to each request, strictly under 60 seconds back."""
    w = Window.partitionBy(partition).orderBy("_us").rangeBetween(-59_999_999, 0)
    timed = requests.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    return timed.withColumn("window_requests", F.count("*").over(w)).withColumn("window_tokens", F.sum(tokens).over(w)).drop("_us")
