"""Array kernels over the UTF-8 bytes of Arrow text columns.

A slice of documents is one byte array with document offsets. Word, line and
shingle boundaries and 64-bit hashes are computed for a whole slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
SPAN_BYTES = 1 << 18
U64 = np.uint64


def _classes(allowed) -> np.ndarray:
    return np.array([allowed(b) for b in range(256)], dtype=bool)


#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = _classes(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing.
ALNUM = _classes(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=U64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, kept for later calls up to a million."""
    global _powers
    if len(_powers) < n:
        grown = np.cumprod(np.concatenate([[U64(1)], np.full(max(n, 4096), _BASE)]), dtype=U64)
        if n > 1 << 20:
            return grown[:n]
        _powers = grown
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a text column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``limit`` text bytes, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def runs(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of maximal runs of member bytes that don't cross documents."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = member[:-1]
    starts = np.flatnonzero(member & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = member[1:]
    ends = np.flatnonzero(member & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are disjoint and in order, none is empty.

    Spans are taken in blocks of ``SPAN_BYTES``, or of one longer span: each byte needs several 64-bit numbers.
    """
    total = np.cumsum(ends - starts)
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        before = int(total[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + SPAN_BYTES, "right")))
        out[at:end] = _span_hash(data, starts[at:end], ends[at:end])
        at = end
    return out


def _span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lens = ends - starts
    first = np.concatenate([[0], np.cumsum(lens)])
    pos = np.arange(first[-1]) - np.repeat(first[:-1], lens)
    terms = _BYTE[data[pos + np.repeat(starts, lens)]] * powers(int(lens.max()))[pos]
    return mix(np.add.reduceat(terms, first[:-1]) + lens.astype(U64))


def window_hash(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of ``width`` neighbours with one owner, and each window's first index."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    acc = np.zeros(n, dtype=U64)
    for k in range(width):
        acc = acc * _BASE + hashes[k : k + n]
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return mix(acc[at] + U64(width)), at


def words(column: pa.Array, member: np.ndarray = SPACED, lower: bool = False) -> dict[str, np.ndarray]:
    """Words of a text column: bytes, offsets, starts, ends, documents and hashes."""
    data, offs = text_buffers(column)
    if lower:
        data = LOWER[data]
    starts, ends, doc = runs(member[data], offs)
    return {"data": data, "offs": offs, "starts": starts, "ends": ends, "doc": doc, "hash": span_hash(data, starts, ends)}
