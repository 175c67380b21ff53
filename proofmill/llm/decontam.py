"""Benchmark passages in documents, by a prefix-filtered join of word windows.

Each benchmark item is a set of windows of ten consecutive words (fewer words: one
window). The words of the benchmark are counted over all documents; a window's
words are ordered by that rarity. A window is contained only if all its words
are, so the necessary prefix is its rarest word alone. A document's words are
looked up among the prefix words; each hit fixes where the window would start,
which must lie with its whole length inside the document; then the hashes of its
words and at last its words themselves are compared.

The windows are used in blocks of a bounded number, each broadcast; more windows
mean more blocks, in one pass over the documents for the counts of all and one for
the search of all. Documents aren't shuffled. Null or empty texts have no words.
Items without words or without an id match nothing; items with one id count once.
Equal items and repeated documents are each reported. Columns of documents pass
by; a column named ``leak`` is replaced. Empty tables give their own rows back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.llm import memo
from proofmill.llm.shared import table, written
from proofmill.llm.vec import ALNUM, U64, slices, words

WINDOW = 10
BLOCK = 200_000
LEAK = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW_LEAK = pa.struct([("n_words", pa.int64()), ("hit", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """A row per window: item, its words joined by spaces, and its words' hashes."""

    @memo.task()
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), ALNUM, lower=True)
                names = part.column("item").to_pylist()
                texts = [w["data"][a:b].tobytes().decode("utf-8", "replace") for a, b in zip(w["starts"], w["ends"], strict=True)]
                hashes = w["hash"].view(np.int64).tolist()
                bounds = np.searchsorted(w["doc"], np.arange(part.num_rows + 1)).tolist()
                item, text, codes = [], [], []
                for k, name in enumerate(names):
                    a, b = bounds[k], bounds[k + 1]
                    for s in range(a, max(a + (b > a), b - width + 1)):
                        e = min(b, s + width)
                        item.append(name)
                        text.append(" ".join(texts[s:e]))
                        codes.append(hashes[s:e])
                yield pa.record_batch({"item": pa.array(item, pa.string()), "window": pa.array(text, pa.string()), "codes": pa.array(codes, pa.list_(pa.int64()))})

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null")
    return items.mapInArrow(cut, "item string, window string, codes array<long>")


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each hash of the (sorted, bounded) vocabulary occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @memo.task()
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        n = np.zeros(len(vocab), np.int64)
        for batch in batches:
            for part in slices(batch):
                h = words(part.column("text"), ALNUM, lower=True)["hash"]
                at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                n += np.bincount(at[vocab[at] == h], minlength=len(vocab))
        some = np.flatnonzero(n)
        yield pa.record_batch({"code": pa.array(vocab[some].view(np.int64)), "n": pa.array(n[some])})

    counted = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {r.code & (2**64 - 1): r.n for r in counted.collect()}  # a row per word of the block at most


def all_word_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """code, n of every word of the windows, however many, in one pass over the documents."""

    @memo.task()
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, n = np.unique(words(part.column("text"), ALNUM, lower=True)["hash"], return_counts=True)
                yield pa.record_batch({"code": pa.array(h.view(np.int64)), "n": pa.array(n, pa.int64())})

    vocabulary = windows.select(F.explode("codes").alias("code")).distinct()
    counted = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return counted.join(vocabulary, "code", "left_semi")


class WindowIndex:
    """Windows of one block by their rarest word."""

    def __init__(self, items: list[list[str]], texts: list[str], codes: list[list[int]], counts: dict[int, int]):
        n, width = len(texts), max(map(len, codes))
        self.items = items
        self.texts = [t.encode() for t in texts]
        self.size = np.array([len(c) for c in codes])
        self.codes = np.zeros((n, width), U64)
        prefix, offset = np.zeros(n, U64), np.zeros(n, np.int64)
        for k, row in enumerate(codes):
            row = [c & (2**64 - 1) for c in row]
            self.codes[k, : len(row)] = np.array(row, U64)
            offset[k] = min(range(len(row)), key=lambda i: (counts.get(row[i], 0), row[i]))
            prefix[k] = row[offset[k]]
        order = np.argsort(prefix, kind="stable")
        self.order, self.offset = order, offset
        self.tokens, self.first = np.unique(prefix[order], return_index=True)
        self.last = np.append(self.first[1:], n)

    def search(self, w: dict[str, np.ndarray], n_docs: int) -> Iterator[tuple[int, int, int, int]]:
        """(document, first word, one past the last word, window) of each occurrence; words count from the slice's start."""
        h, doc = w["hash"], w["doc"]
        if not len(h):
            return
        at = np.minimum(np.searchsorted(self.tokens, h), len(self.tokens) - 1)
        pos = np.flatnonzero(self.tokens[at] == h)
        for some in np.array_split(pos, max(1, len(pos) // 100_000)):
            a, b = self.first[at[some]], self.last[at[some]]
            n = b - a
            where = np.repeat(some, n)
            which = self.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
            begin = where - self.offset[which]
            end = begin + self.size[which]
            ok = (begin >= 0) & (end <= len(h))
            where, which, begin, end = where[ok], which[ok], begin[ok], end[ok]
            ok = (doc[begin] == doc[where]) & (doc[end - 1] == doc[where])
            which, begin, end = which[ok], begin[ok], end[ok]
            for k in range(self.codes.shape[1]):
                ok = (k >= self.size[which]) | (h[np.minimum(begin + k, len(h) - 1)] == self.codes[which, k])
                which, begin, end = which[ok], begin[ok], end[ok]
            data, starts, ends = w["data"], w["starts"], w["ends"]
            for j, s, e in zip(which.tolist(), begin.tolist(), end.tolist(), strict=True):
                if b" ".join(data[starts[x] : ends[x]].tobytes() for x in range(s, e)) == self.texts[j]:
                    yield int(doc[s]), s, e, j


def _marked(part: pa.RecordBatch, index: WindowIndex) -> pa.Array:
    w = words(part.column("text"), ALNUM, lower=True)
    bounds = np.searchsorted(w["doc"], np.arange(part.num_rows + 1))
    found: dict[int, tuple[set, set]] = {}
    for d, s, e, j in index.search(w, part.num_rows):
        hit, items = found.setdefault(d, (set(), set()))
        hit.update(range(s - int(bounds[d]), e - int(bounds[d])))
        items.update(index.items[j])
    before = part.column("leak").to_pylist() if "leak" in part.schema.names else [None] * part.num_rows
    out = []
    for d, old in enumerate(before):
        hit, items = found.get(d, (set(), set()))
        if old:
            hit, items = hit | set(old["hit"]), items | set(old["items"])
        out.append({"n_words": int(bounds[d + 1] - bounds[d]), "hit": sorted(hit), "items": sorted(items)})
    return pa.array(out, _ARROW_LEAK)


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Documents with ``leak``: n_words, the words inside occurrences of a window (counted from 0), and the items."""
    docs = docs.drop("leak")
    spark = docs.sparkSession
    windows = written(windows_of(benchmark, width).groupBy("window").agg(F.min("codes").alias("codes"), F.collect_set("item").alias("items")), "windows")
    blocks = max(1, -(-windows.count() // block))
    counts = written(all_word_counts(docs, windows), "counts") if blocks > 1 else None
    out = docs
    for k in range(blocks):
        mine = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        some = mine.collect()  # about a block of rows
        if some:
            if counts is None:
                often = word_counts(docs, np.unique(np.array([c & (2**64 - 1) for r in some for c in r.codes], dtype=U64)))
            else:
                often = {r.code & (2**64 - 1): r.n for r in counts.join(mine.select(F.explode("codes").alias("code")).distinct(), "code", "left_semi").collect()}  # a row per word of the block at most
            index = WindowIndex([r["items"] for r in some], [r.window for r in some], [r.codes for r in some], often)
        else:
            index = WindowIndex([[]], ["\0"], [[0]], {})
        out = _with_block(out, spark.sparkContext.broadcast(index))
    return out


def _with_block(docs: DataFrame, shared) -> DataFrame:
    names = [c for c in docs.columns if c != "leak"]

    @memo.task()
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = [part.column(c) for c in names] + [_marked(part, shared.value)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "leak"])

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("leak", LEAK)])
    return docs.mapInArrow(mark, schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "leak.n_words",
        F.size("leak.hit").cast("long").alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"),
        (F.size("leak.hit") > 0).alias("contaminated"),
    )
