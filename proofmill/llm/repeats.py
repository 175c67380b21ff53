"""Repeated byte strings, by maximal repeats of enhanced suffix arrays.

A string of ``LENGTH`` bytes that starts earlier too (in a document of smaller id, or
earlier in its own) marks its bytes for removal; all are judged on the input.

No suffix array spans the corpus. Each string has an anchor: its 32-byte gram of
least hash (the first, in ties). Neighbouring strings share an anchor and form a
stretch; equal strings have equal anchors, so only stretches with one anchor hash
can hold equal strings. They meet by a shuffle on that hash and are read as a stream:

* Stretches with equal bytes (128 bits of hashes tell): all but the first are repeats
  in whole. Runs of one stretch in periodic text, and stretches that an earlier
  document of the same task has, are settled before the shuffle, so a line that
  millions of documents hold sends a few rows from each task, not one from each copy.
* The firsts of an anchor's different stretches, where the 34 bytes on one side may
  agree (nine-bit marks tell), go on with their bytes to suffix arrays. An array
  takes many anchors' stretches at once, sorts their suffixes by rank doubling, and
  scans its common prefixes with a stack into the tree of intervals. An interval of
  at least LENGTH bytes whose occurrences have different bytes before them is a
  maximal repeat; it is put out with all its occurrences. All but its first
  occurrence are repeats.
* An anchor with more than ``GROUP`` such stretches doesn't go to one task: its
  strings are grouped by 128-bit hash with a partial minimum.

Null texts are empty; texts shorter than LENGTH bytes lose nothing. Of documents
with one id, the one with the smaller text hash comes first, and of equal rows one
counts as the first. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.llm import memo
from proofmill.llm.shared import at_most, maybe_broadcast, table, written
from proofmill.llm.vec import _BASE, _BYTE, U64, mix, powers, slices, text_buffers

LENGTH, GRAM = 100, 32
GRAMS = LENGTH - GRAM + 1  # in a string
SIDE = (LENGTH - GRAM) // 2
GROUP = 20_000
HELD = 4096
CHUNK = 1 << 20
IDS = 4_000_000
PAD = 72
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_inverse_powers = np.ones(1, U64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse_powers
    if len(_inverse_powers) < n:
        _inverse_powers = np.cumprod(np.concatenate([[U64(1)], np.full(n, _INVERSE)]), dtype=U64)
    return _inverse_powers[:n]


def stretches(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Stretches of strings with one anchor: document, first and last start in it, anchor, hashes and side marks."""
    n = len(data)
    names = ("doc", "lo", "span", "anchor", "h", "bytes", "left", "right")
    if n < LENGTH:
        return {c: np.zeros(0, U64 if c in ("h", "bytes") else np.int64) for c in names}
    g = _BYTE[data]
    width, base = 1, _BASE
    while width < GRAM:
        g = g[: len(g) - width] * base + g[width:]
        width, base = 2 * width, U64(pow(int(base), 2, 1 << 64))
    g = mix(g)
    key = (g & ~U64(0xFFFFFFFF)) | np.arange(len(g), dtype=U64)
    width = 1
    while 2 * width <= GRAMS:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    key = np.minimum(key[: len(key) - (GRAMS - width)], key[GRAMS - width :])
    anchor = (key & U64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    starts = np.flatnonzero(doc[: n - LENGTH + 1] == doc[LENGTH - 1 :])
    if not len(starts):
        return stretches(data[:0], offs[:1])
    a = anchor[starts]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, a = starts[first], starts[last], a[first]
    prefix = np.concatenate([[U64(0)], np.cumsum(_BYTE[data] * powers(n), dtype=U64)])
    inverse = inverse_powers(n + 1)
    hashed = lambda s, e: mix((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(U64))
    at = doc[lo]
    span = hashed(lo, hi + LENGTH) ^ mix((a - lo).astype(U64))
    # nine bits of the bytes beside the anchor, 0 where the stretch has fewer
    left = np.where(a - lo >= SIDE, 1 + (hashed(np.maximum(a - SIDE, 0), a) % U64(511)).astype(np.int64), 0)
    after = a + GRAM
    right = np.where(hi + LENGTH - after >= SIDE, 1 + (hashed(after, np.minimum(after + SIDE, n)) % U64(511)).astype(np.int64), 0)
    return {"doc": at, "lo": lo - offs[at], "span": hi - lo, "anchor": a - lo, "h": g[a], "bytes": span, "left": left, "right": right}


def _pack(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["lo"] << 32) | (s["span"] << 25) | (s["anchor"] << 18) | (s["left"] << 9) | s["right"]


@memo.task()
def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common = _Common()
    for batch in batches:
        for part in slices(batch):
            ids, th = part.column("doc_id").to_numpy(zero_copy_only=False), part.column("th").to_numpy(zero_copy_only=False)
            data, offs = text_buffers(part.column("text"))
            # a long text is read in pieces that overlap by a string less a byte
            for at in range(0, max(1, len(data) - LENGTH + 1), CHUNK) if part.num_rows == 1 else (0,):
                if part.num_rows == 1:
                    piece = data[at : at + CHUNK + LENGTH - 1]
                    s = stretches(piece, np.array([0, len(piece)]))
                    s["lo"] = s["lo"] + at
                else:
                    s = stretches(data, offs)
                if not len(s["lo"]):
                    continue
                s, *periodic = _periodic(s)
                s, *earlier = _held_before(s, ids, th, common)
                # what is settled here is dealt out by its place
                doc, lo, end = (np.concatenate(x) for x in zip(periodic, earlier, strict=True))
                h = np.concatenate([s["h"].view(np.int64), mix((lo + 7919 * end).astype(U64) ^ mix(ids[doc].astype(np.int64).view(U64))).view(np.int64)])
                owner = np.concatenate([s["doc"], doc])
                none = pa.nulls(len(s["lo"]), pa.int64())
                yield pa.record_batch(
                    {
                        "h": pa.array(h),
                        "bytes": pa.array(np.concatenate([s["bytes"].view(np.int64), np.zeros(len(doc), np.int64)])),
                        "doc_id": pa.array(ids[owner]),
                        "th": pa.array(th[owner]),
                        "packed": pa.array(np.concatenate([_pack(s), lo << 32])),
                        "end": pa.concat_arrays([none, pa.array(end)]),
                    }
                )


_OUT = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("packed", pa.int64()), ("end", pa.int64())])


def _periodic(s: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Stretches without those equal to the one right before them, and the runs of the latter: document, from, to."""
    n = len(s["lo"])
    same = np.zeros(n, bool)
    hi = s["lo"] + s["span"]
    same[1:] = (s["h"][1:] == s["h"][:-1]) & (s["bytes"][1:] == s["bytes"][:-1]) & (s["doc"][1:] == s["doc"][:-1]) & (s["lo"][1:] == hi[:-1] + 1)
    first = np.flatnonzero(same & ~np.concatenate([[False], same[:-1]]))
    last = np.flatnonzero(same & ~np.concatenate([same[1:], [False]]))
    return {c: v[~same] for c, v in s.items()}, s["doc"][first], s["lo"][first], hi[last] + LENGTH


class _Common:
    """Stretches that a task has met twice or more: hashes, and the first place so far. Only how much is shuffled depends on it."""

    def __init__(self, most: int = 200_000):
        self.most = most
        self.rows = {c: np.zeros(0, U64 if c in ("key", "h", "bytes") else np.int64) for c in ("key", "h", "bytes", "id", "th", "lo")}

    def earlier(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        """Which rows come after a known place of the same stretch."""
        held = self.rows
        if not len(held["key"]):
            return np.zeros(len(rows["key"]), bool)
        at = np.minimum(np.searchsorted(held["key"], rows["key"]), len(held["key"]) - 1)
        same = (held["h"][at] == rows["h"]) & (held["bytes"][at] == rows["bytes"])
        later, open_ = np.zeros(len(at), bool), same
        for c in ("id", "th", "lo"):
            later |= open_ & (held[c][at] < rows[c])
            open_ = open_ & (held[c][at] == rows[c])
        return later

    def add(self, rows: dict[str, np.ndarray]) -> None:
        if len(self.rows["key"]) > self.most:
            self.rows = {c: v[:0] for c, v in self.rows.items()}
        both = {c: np.concatenate([self.rows[c], v]) for c, v in rows.items()}
        order = np.lexsort(tuple(both[c] for c in ("lo", "th", "id", "key")))
        key = both["key"][order]
        order = order[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
        self.rows = {c: v[order] for c, v in both.items()}


def _held_before(s: dict[str, np.ndarray], ids: np.ndarray, th: np.ndarray, common: _Common) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Stretches without those that came before in this task, and the latter's merged ranges: document, from, to."""
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((th, ids))] = np.arange(len(ids))
    key = s["h"] ^ mix(s["bytes"])
    order = np.lexsort(((rank[s["doc"]] << 32) | s["lo"], key))
    same = np.zeros(len(key), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (s["h"][order][1:] == s["h"][order][:-1]) & (s["bytes"][order][1:] == s["bytes"][order][:-1])
    gone = np.zeros(len(key), bool)
    gone[order[same]] = True
    rows = {"key": key, "h": s["h"], "bytes": s["bytes"], "id": ids[s["doc"]], "th": th[s["doc"]], "lo": s["lo"]}
    firsts = order[:-1][same[1:] & ~same[:-1]]
    gone |= common.earlier(rows)
    common.add({c: v[firsts[~gone[firsts]]] for c, v in rows.items()})
    doc, lo = s["doc"][gone], s["lo"][gone]
    end = lo + s["span"][gone] + LENGTH
    run = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > end[:-1])])[: len(doc)])
    last = np.append(run[1:], len(doc)) - 1 if len(run) else run
    return {c: v[~gone] for c, v in s.items()}, doc[run], lo[run], end[last]


@memo.task()
def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, bytes, doc_id, th, packed: repeats in whole (h null), and firsts that may share strings."""
    open_h = open_bytes = None
    held: list[tuple] = []  # firsts of the open anchor, until there are too many to compare

    def fits(rows: list[tuple]) -> list[tuple]:
        """Firsts that have a side in common with another."""
        if len(rows) < 2:
            return []
        sides: dict = {}
        for _, _, _, packed in rows:
            for side in (packed >> 9 & 511, 512 + (packed & 511)):
                sides[side] = sides.get(side, 0) + 1
        return [r for r in rows if ((x := r[3] >> 9 & 511) and sides[x] > 1) or ((y := r[3] & 511) and sides[512 + y] > 1)]

    full = False
    for batch in batches:
        settled = pc.is_valid(batch.column("end"))
        if pc.any(settled).as_py():
            done = batch.filter(settled)
            yield pa.RecordBatch.from_arrays([pa.nulls(done.num_rows, pa.int64()), *(done.column(c) for c in ("doc_id", "th", "packed", "end"))], schema=_OUT)
            batch = batch.filter(pc.invert(settled))
        h, b, doc, th, packed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "bytes", "doc_id", "th", "packed"))
        n = len(h)
        if not n:
            continue
        new_h = np.concatenate([[h[0] != open_h], h[1:] != h[:-1]])
        new_b = new_h | np.concatenate([[b[0] != open_bytes], b[1:] != b[:-1]])
        again = ~new_b
        out: list[tuple] = []
        first_rows = np.flatnonzero(new_b)
        # an anchor with one stretch needs nothing: only rows whose anchor has other firsts are looked at one by one
        alone = new_h[first_rows] & np.append(new_h[first_rows][1:], False)
        for i, single in zip(first_rows.tolist(), alone.tolist(), strict=True):
            if new_h[i]:
                out += [] if full else fits(held)
                held, full = [], False
                if single:
                    continue
            row = (int(h[i]), int(doc[i]), int(th[i]), int(packed[i]))
            if full:
                out.append(row)
                continue
            held.append(row)
            if len(held) > HELD:
                out += held
                held, full = [], True
        open_h, open_bytes = h[-1], b[-1]
        if again.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(int(again.sum()), pa.int64()), pa.array(doc[again]), pa.array(th[again]), pa.array(packed[again]), pa.nulls(int(again.sum()), pa.int64())], schema=_OUT)
        if out:
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*out, strict=True)), pa.nulls(len(out), pa.int64())], schema=_OUT)
    if held and not full and (out := fits(held)):
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*out, strict=True)), pa.nulls(len(out), pa.int64())], schema=_OUT)


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(U64)


class SuffixIntervals:
    """The enhanced suffix array of byte strings, for suffixes that start in their first ``spans`` + 1 bytes."""

    def __init__(self, contexts: list[bytes], spans: np.ndarray, least: int = LENGTH):
        lens = np.array([len(c) for c in contexts])
        buf = np.frombuffer(b"".join(c + bytes(PAD) for c in contexts) + bytes(4 * PAD), np.uint8)
        first = np.concatenate([[0], np.cumsum(lens + PAD)[:-1]])
        count = spans + 1
        owner = np.repeat(np.arange(len(contexts)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pos = first[owner] + at
        left = lens[owner] - at
        v = buf.astype(U64)
        for k in (1, 2, 4):
            v = (v[: len(v) - k] << U64(8 * k)) | v[k:]
        eight, r = v, _ranks(v)
        levels = {8: r}
        for k in (8, 16, 32):
            r = _ranks((r[: len(r) - k] << U64(32)) | r[k:])
            levels[2 * k] = r
        order = np.lexsort((r[pos + 104], r[pos + 64], r[pos]))
        self.pos, self.owner, self.at, left = pos[order], owner[order], at[order], left[order]
        # common prefixes of neighbours, up to the end of the shorter suffix
        i, j = self.pos[:-1], self.pos[1:]
        lcp = np.zeros(len(i), np.int64)
        for k in (64, 64, 32, 16, 8):
            same = levels[k][i + lcp] == levels[k][j + lcp]
            lcp += np.where(same, k, 0)
        differ = eight[i + lcp] ^ eight[j + lcp]
        for _ in range(7):
            top = (differ >> U64(56)) == 0
            lcp += top & (differ != 0)
            differ = np.where(top, differ << U64(8), U64(1) << U64(63))
        self.lcp = np.minimum(lcp, np.minimum(left[:-1], left[1:]))
        self.before = np.where(self.at > 0, buf[np.maximum(self.pos - 1, 0)].astype(np.int64), -1 - self.owner)
        self.least = least

    def maximal_repeats(self) -> Iterator[tuple[int, int, int]]:
        """(length, first, last) of each interval of the array whose occurrences differ in the byte before them."""
        lcp, before = self.lcp, self.before
        deep = np.flatnonzero(np.concatenate([[False], lcp >= self.least]) | np.concatenate([lcp >= self.least, [False]]))
        stack: list[list] = []  # length, first index, the byte before all (None: different ones)
        depth = np.append(lcp, 0)
        previous = -2
        for k in deep.tolist():
            if k != previous + 1:
                stack = []
            previous = k
            mark = int(before[k])
            here = mark if mark >= 0 else None
            top = int(depth[k])
            start = k
            carried = here
            # suffix k ends every interval deeper than what it shares with the next
            if stack:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == here else None
            while stack and stack[-1][0] > top:
                length, start, carried = stack.pop()
                if carried is None:
                    yield length, start, k
                if stack:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == carried else None
            if top >= self.least and (not stack or stack[-1][0] < top):
                stack.append([top, start, carried])


def _repeat_rows(rows: list[tuple]) -> tuple[list, list, list, list]:
    """Rows (h, doc_id, th, lo, span, anchor, bytes): removed (doc_id, th, from, to)."""
    # a shared string holds the anchor and 34 bytes on one side: others can't meet
    sides: dict = {}
    keys = []
    for h, _, _, _, _, a, text in rows:
        k = ((h, 0, text[a - SIDE : a]) if a >= SIDE else None, (h, 1, text[a + GRAM : a + GRAM + SIDE]) if len(text) - a - GRAM >= SIDE else None)
        keys.append(k)
        for x in k:
            if x is not None:
                sides[x] = sides.get(x, 0) + 1
    rows = [r for r, k in zip(rows, keys, strict=True) if any(x is not None and sides[x] > 1 for x in k)]
    out: tuple[list, list, list, list] = ([], [], [], [])
    if not rows:
        return out
    array = SuffixIntervals([r[6] for r in rows], np.array([r[4] for r in rows]))
    place = [(r[1], r[2], r[3]) for r in rows]
    owner, at = array.owner.tolist(), array.at.tolist()
    ranges: dict[tuple, list] = {}
    for length, first, last in array.maximal_repeats():
        found = [(*place[owner[k]][:2], place[owner[k]][2] + at[k]) for k in range(first, last + 1)]
        earliest = min(found)
        for f in found:
            if f != earliest:
                ranges.setdefault(f[:2], []).append((f[2], f[2] + length))
    for doc, spans in ranges.items():
        for lo, end in _merged(spans):
            for column, x in zip(out, (*doc, lo, end), strict=True):
                column.append(x)
    return out


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for lo, end in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((lo, end))
    return out


@memo.task()
def _by_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def done() -> pa.RecordBatch:
        return pa.record_batch({c: pa.array(v, pa.int64()) for c, v in zip(("doc_id", "th", "lo", "end"), _repeat_rows(held), strict=True)})

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "th", "lo", "span", "anchor", "bytes")), strict=True):
            if size > 1 << 20 and row[0] != held[-1][0]:
                yield done()
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        yield done()


@memo.task()
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the stretches by its 128-bit hash, for anchors too common for one task."""
    for batch in batches:
        rows = ([], [], [], [])
        for doc, th, lo, span, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "lo", "span", "bytes")), strict=True):
            for k in range(span + 1):
                for column, x in zip(rows, (hashlib.blake2b(text[k : k + LENGTH], digest_size=16).digest(), doc, th, lo + k), strict=True):
                    column.append(x)
        yield pa.record_batch({"name": pa.array(rows[0], pa.binary())} | {c: pa.array(v, pa.int64()) for c, v in zip(("doc_id", "th", "lo"), rows[1:], strict=True)})


@memo.task()
def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            out = []
            for doc, th, text, firsts in zip(*(part.column(c).to_pylist() for c in ("doc_id", "th", "text", "firsts")), strict=True):
                raw = (text or "").encode()
                for f in firsts:
                    p = f["packed"]
                    lo, span, anchor = p >> 32, p >> 25 & 127, p >> 18 & 127
                    out.append((f["h"], doc, th, lo, span, anchor, raw[lo : lo + span + LENGTH]))
            kinds = (pa.int64(),) * 6 + (pa.binary(),)
            yield pa.record_batch({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(zip(("h", "doc_id", "th", "lo", "span", "anchor", "bytes"), kinds, strict=True))})


def _recurs(docs: DataFrame, *columns: str) -> bool:
    return docs.groupBy(*columns).count().filter("count > 1").limit(1).count() > 0


def keyed(docs: DataFrame, recurring: bool) -> DataFrame:
    """doc_id, th, text; th tells documents of one id apart and is 0 where no id recurs."""
    return docs.select("doc_id", (F.xxhash64("text") if recurring else F.lit(0).cast("long")).alias("th"), "text")


def _with_texts(docs: DataFrame, info: DataFrame) -> DataFrame:
    """Inner join of keyed documents and a table by document; documents outside are dropped before the shuffle where their ids are few."""
    ids = info.select("doc_id").distinct()
    if at_most(ids, IDS):
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.join(info, ["doc_id", "th"])


def removed_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, th, lo, end: byte ranges that the rule removes (they may overlap). ``docs`` as from ``keyed``."""
    sorted_ = docs.select("doc_id", "th", "text").mapInArrow(_anchors, "h long, bytes long, doc_id long, th long, packed long, end long").repartition("h").sortWithinPartitions("h", "bytes", "doc_id", "th", "packed")
    found = written(sorted_.mapInArrow(_classes, "h long, doc_id long, th long, packed long, end long"), "stretches")
    lo = F.shiftright("packed", 32)
    whole = found.filter("h is null").select("doc_id", "th", lo.alias("lo"), F.coalesce("end", lo + F.shiftright("packed", 25).bitwiseAND(F.lit(127)) + LENGTH).alias("end"))
    firsts = found.filter("h is not null")
    giant = written(firsts.groupBy("h").count().filter(F.col("count") > GROUP).select("h"), "giant")
    lists = firsts.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "packed")).alias("firsts"))
    contexts = _with_texts(docs, lists).mapInArrow(_contexts, "h long, doc_id long, th long, lo long, span long, anchor long, bytes binary")
    some = giant.limit(1).count() > 0
    if some:
        contexts, giant = written(contexts, "contexts"), maybe_broadcast(giant, IDS)
    usual = contexts.join(giant, "h", "left_anti") if some else contexts
    out = whole.unionByName(usual.repartition("h").sortWithinPartitions("h").mapInArrow(_by_suffixes, "doc_id long, th long, lo long, end long"))
    if some:
        strings = contexts.join(giant, "h", "left_semi").mapInArrow(_windows, "name binary, doc_id long, th long, lo long")
        first = strings.groupBy("name").agg(F.min(F.struct("doc_id", "th", "lo")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("name", "first")
        out = out.unionByName(strings.join(first, "name").filter("struct(doc_id, th, lo) <> first").select("doc_id", "th", "lo", (F.col("lo") + LENGTH).alias("end")))
    return out


@memo.task()
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            rows = []
            for doc, text, ranges in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "ranges")), strict=True):
                raw = (text or "").encode()
                kept, at, spans, gone = [], 0, 0, 0
                begin = end = -1
                for x in [*sorted(ranges), None]:
                    lo, hi = (x >> 32, x & 0xFFFFFFFF) if x is not None else (len(raw) + 1, 0)
                    if lo <= end:
                        end = max(end, hi)
                        continue
                    if end > begin:
                        kept.append(raw[at:begin])
                        at, spans, gone = end, spans + 1, gone + end - begin
                    begin, end = lo, hi
                kept.append(raw[at:])
                rest = b"".join(kept)
                rows.append((doc, len(raw), gone, spans, hashlib.sha256(rest).hexdigest()))
            kinds = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.record_batch({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), kinds, strict=True))})


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(source: DataFrame) -> DataFrame:
    """Per document of ``source`` (doc_id, text): n_bytes, n_removed, n_spans and the hash of what is left."""
    recurring = _recurs(source, "doc_id")
    docs = keyed(source, recurring)
    twice = recurring and _recurs(docs, "doc_id", "th")
    # equal rows are looked at once
    ranges = removed_ranges(docs.dropDuplicates(["doc_id", "th"]) if twice else docs).select("doc_id", "th", F.shiftleft("lo", 32).bitwiseOR(F.col("end")).alias("range"))
    by_doc = written(ranges.groupBy("doc_id", "th").agg(F.collect_set("range").alias("ranges")), "ranges")
    if twice:
        # equal rows after the first lose all that is long enough
        number = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("text"))
        size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
        docs = docs.withColumn("number", number)
        every = F.when(size >= LENGTH, F.array(size)).otherwise(F.array().cast("array<long>"))
        return docs.join(by_doc, ["doc_id", "th"], "left").withColumn("ranges", F.when(F.col("number") > 1, every).otherwise(F.coalesce("ranges", F.array().cast("array<long>")))).select("doc_id", "text", "ranges").mapInArrow(_cut, _RESULT)
    cut = _with_texts(docs, by_doc).select("doc_id", "text", "ranges").mapInArrow(_cut, _RESULT)
    ids = by_doc.select("doc_id", "th")
    whole = docs.join(F.broadcast(ids) if at_most(ids, IDS) else ids, ["doc_id", "th"], "left_anti")
    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    return cut.unionByName(whole.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256")))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
