"""Token ids in Arrow files of fixed-size lists.

``write_token_files`` tokenizes documents in ascending id order and writes Arrow IPC
files to a shared folder, each of a range of ids and of about ``FILE_BYTES`` of text.
Each row holds ``length`` ids (the smallest unsigned type that fits the vocabulary)
and a mask, both as fixed-size lists; only the last row of a file is padded, with
mask false. All record batches but a file's last have ``ROWS_PER_BATCH`` rows, so
``TokenFile.row(k)`` finds row k of a mapped file by division and returns views of
the file's own bytes. The list columns ``doc_id`` and ``doc_at`` name the documents
that begin in a row and where. ``read_token_files`` rebuilds the documents.

A file is written under a name of its own attempt and named in the manifest by
the attempt that Spark counts, so a retried task can't mix with a lost one.
Null texts are empty texts; an empty text still has its end id. Repeated ids
keep one entry per row, ordered by text hash. An empty table gives no file and
no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import memo
from proofmill.llm.chunks import encoder
from proofmill.llm.shared import scratch, table
from proofmill.llm.vec import slices

LENGTH = 2048
ROWS_PER_BATCH = 256
FILE_BYTES = 64 << 20
ENCODED_BYTES = 4 << 20  # text that is encoded at once
KEEP = 450_000  # pieces in a generation of the encoder's table
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length)), ("doc_id", pa.list_(pa.int64())), ("doc_at", pa.list_(pa.int32()))])


class _Writer:
    """Collects ids and writes full record batches; holds at most one batch and one document."""

    def __init__(self, path: str, kind: np.dtype, length: int):
        self.kind, self.length, self.schema = kind, length, _schema(kind, length)
        self.system, self.path = fs.FileSystem.from_uri(path)
        self.file = self.system.open_output_stream(self.path)
        self.writer = pa.ipc.new_file(self.file, self.schema)
        self.pending, self.held, self.docs, self.tokens = [], 0, [], 0

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs.append((self.held, doc_id))
        self.pending.append(ids)
        n = len(ids) // self.kind.itemsize
        self.held += n
        self.tokens += n
        if self.held >= self.length * ROWS_PER_BATCH:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        """Write the full batches that are held, and at the end of the file the rest."""
        ids = np.frombuffer(b"".join(self.pending), dtype=self.kind)
        at, full = 0, self.length * ROWS_PER_BATCH
        while len(ids) - at >= full:
            self._write(ids[at : at + full], at)
            at += full
        if last and at < len(ids):
            self._write(ids[at:], at)
            at = len(ids)
        self.docs = [(x - at, doc) for x, doc in self.docs if x >= at]
        self.pending, self.held = [ids[at:].tobytes()], len(ids) - at

    def _write(self, ids: np.ndarray, base: int) -> None:
        """One batch; ``base`` is the place of its first id among those held."""
        rows = -(-len(ids) // self.length)
        size = rows * self.length
        flat = np.zeros(size, dtype=self.kind)
        flat[: len(ids)] = ids
        inside = [(x - base, doc) for x, doc in self.docs if base <= x < base + len(ids)]
        begins = np.array([x for x, _ in inside], np.int64)
        offsets = pa.array(np.searchsorted(begins, np.arange(rows + 1) * self.length).astype(np.int32))
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(size) < len(ids)), self.length),
            pa.ListArray.from_arrays(offsets, pa.array([doc for _, doc in inside], pa.int64())),
            pa.ListArray.from_arrays(offsets, pa.array((begins % self.length).astype(np.int32))),
        ]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(last=True)
        self.writer.close()
        self.file.close()


def smallest_type(tokenizer: str) -> str:
    """The smallest unsigned type that holds every id of the tokenizer's vocabulary."""
    from tokenizers import Tokenizer

    top = max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=0)
    return next(t for t in ("<u1", "<u2", "<u4") if top <= np.iinfo(t).max)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, length: int = LENGTH, dtype: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``docs`` (doc_id, text) and return the manifest: path, first_id, n_docs, n_tokens."""
    spark = docs.sparkSession
    dtype = dtype or smallest_type(tokenizer)
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).first().bytes or 0
    parts = max(1, spark.sparkContext.defaultParallelism, -(-total // file_bytes))
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    kind = np.dtype(dtype)
    end = np.array([end_id], kind).tobytes()

    @memo.task("chunks")
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first, n_docs = None, None, 0
        enc = encoder(tokenizer, dtype, KEEP)
        for batch in batches:
            for part in slices(batch, limit=ENCODED_BYTES):
                ids = part.column("doc_id").to_pylist()
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, got in zip(ids, enc.encode(texts), strict=True):
                    if out is None:
                        path, first = f"{folder}/{uuid.uuid4().hex}.arrow", doc_id
                        out = _Writer(path, kind, length)
                    out.add(doc_id, got + end)
                    n_docs += 1
        if out is not None:
            out.close()
            yield pa.record_batch({"path": [path], "first_id": pa.array([first], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([out.tokens], pa.int64())})

    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place, recursive=True)
    return ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(write, "path string, first_id long, n_docs long, n_tokens long")


def read_token_files(spark: SparkSession, manifest: list[tuple[str, int]]) -> DataFrame:
    """Documents of the files: manifest lists (path, ids in all files before it)."""

    @memo.task()
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                yield from documents(path, base)

    frame = spark.createDataFrame(manifest, "path string, base long").repartition(max(1, len(manifest)), "path") if manifest else spark.createDataFrame([], "path string, base long")
    return frame.mapInArrow(read, RESULT)


def _opened(path: str) -> pa.ipc.RecordBatchFileReader:
    """A reader of the file; a local one is mapped, not read."""
    system, place = fs.FileSystem.from_uri(path)
    return pa.ipc.open_file(pa.memory_map(place) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(place))


class TokenFile:
    """Random access to the rows of one file; nothing of a mapped file is copied or decoded."""

    def __init__(self, path: str):
        self.reader = _opened(path)
        self.batches = self.reader.num_record_batches
        last = self.reader.get_batch(self.batches - 1).num_rows if self.batches else 0
        self.rows = max(0, self.batches - 1) * ROWS_PER_BATCH + last

    def __len__(self) -> int:
        return self.rows

    def row(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids of row k as a view of the file's bytes, and its mask (bits of the file)."""
        if not 0 <= k < self.rows:
            raise IndexError(f"row {k} of {self.rows}")
        batch, i = self.reader.get_batch(k // ROWS_PER_BATCH), k % ROWS_PER_BATCH
        ids, mask = batch.column("input_ids"), batch.column("mask")
        n = ids.type.list_size
        return ids.values[i * n : (i + 1) * n].to_numpy(zero_copy_only=True), mask.values[i * n : (i + 1) * n]


def documents(path: str, base: int = 0) -> Iterator[pa.RecordBatch]:
    """Per document of one file: id, start, ids and their checksum, batch by batch."""
    reader = _opened(path)
    at, open_doc, crc, n = base, None, 0, 0
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        ids_column, mask = batch.column("input_ids"), batch.column("mask")
        length = ids_column.type.list_size
        ids = ids_column.flatten().to_numpy(zero_copy_only=True)
        ids = ids[: int(mask.flatten().true_count)]
        starts = np.asarray(batch.column("doc_at").flatten()).astype(np.int64)
        rows = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column("doc_at").offsets)))
        starts = starts + rows * length
        names = batch.column("doc_id").flatten().to_pylist()
        wide = ids.astype("<u4")
        out, cuts = [], [*starts.tolist(), len(ids)]
        if open_doc is not None and cuts[0] > 0:
            crc, n = zlib.crc32(wide[: cuts[0]], crc), n + cuts[0]
        for i, name in enumerate(names):
            if open_doc is not None:
                out.append((*open_doc, n, crc))
            piece = wide[cuts[i] : cuts[i + 1]]
            open_doc, crc, n = (name, at + cuts[i]), zlib.crc32(piece), len(piece)
        at += len(ids)
        if k == reader.num_record_batches - 1 and open_doc is not None:
            out.append((*open_doc, n, crc))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.record_batch({c: pa.array(v, pa.int64()) for c, v in zip(("doc_id", "start", "n_tokens", "ids_crc32"), cols, strict=True)})


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "token-files", kept=True)
    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, folder)
    base, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r.first_id):  # a row per file
        rows.append((r.path, base))
        base += r.n_tokens
    return read_token_files(spark, rows)
