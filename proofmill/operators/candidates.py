"""Candidate pairs and best pairs of whole sessions, without a row for every pair.

A session's claims are dealt into blocks of claims that look alike; two blocks meet in one
task, as arrays. Fields are compared once for each two distinct values, and most pairs are
decided by bounds of their score. Only what is left gets sequence ratios, once for each two
values in one direction, and only pairs that are asked for leave the task as rows.

Why no pair is lost: a score grows with the likeness of every field, and from ``shared
context`` to ``related predicate`` to ``same predicate``. With at most three cues, each of
them a shared word, the second is above the first by 45 - 28 - 12 - 6 + 8 - 3 or more
(28, 23, 16, 5, 0 for four or more, three, two, one, no shared words), the third above
the second by 25 - 12 - 2.5 - 9. So ratios of 0 give a score that isn't above the true one,
and ratios bounded by the letters that two values have in common one that isn't below it.
Pairs whose upper bound is under the threshold are left out; those whose lower bound reaches
it are in; the rest is scored. For the best pairs the k-th lower bound is the threshold.

Pairs of one document or one claim never count. Null documents differ from all.

Two blocks are few bytes and up to a million pairs, so groups are dealt to a number of tasks that doesn't follow their
bytes.

Linking (``linked``) needs no scores, so claims that no score and no rule tells apart go as one row, a kind, with up to
``MANY`` members. Two kinds are looked at once in each direction, what is known of them before comes to their blocks'
group, and only there are their members made pairs, by Spark (``expanded``). Stored pairs are taken out as members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions import matching
from proofmill.functions import text as X
from proofmill.functions import units as U
from proofmill.operators.pairs import FIELDS, THRESHOLD, TOP, prepared

BLOCK, STRIP = 1024, 256
#: Members of a kind's row, and claims that a row counts as at least: a block has up to ``BLOCK`` rows, and ``LEAST`` times as many claims.
MANY, LEAST = 128, 2
#: Products of distinct values of a field up to this many get their ratios before any pair is looked at.
FEW = 1024
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789% "
REASONS = ("shared_context", "same_subject_related_predicate", "same_subject_and_predicate")
#: What so many shared words are worth without a common subject.
SHARED = np.array([0, 5, 16, 23, 28], float)


def narrow(claims: DataFrame, *also: str) -> DataFrame:
    """What a score needs of claims with ``ord``: one text for each of FIELDS (null where it is missing), and the words of the whole claim; columns ``also`` stay."""
    p = prepared(claims.filter("session_id is not null"))
    key = {f: F.when(X.filled(F.col(f)).isNotNull(), F.col(f"n_{f}")) for f in FIELDS} | {f: X.filled(F.col(f"n_{f}")) for f in ("subject", "predicate")}
    family = U.unit_family(U.unit_tokens(F.col("unit")))
    return p.select(
        "session_id",
        "ord",
        "id",
        X.filled(F.col("document_id")).alias("doc"),
        *(key[f].alias(f) for f in FIELDS),
        X.filled(F.col("period")).alias("raw_period"),
        F.array_join("t_claim", " ").alias("words"),
        family.alias("unit"),
        X.filled(X.normalize(F.col("value_type"))).alias("kind"),
        *also,
    )


class _Field:
    """The distinct values of a field in one block: each row's number of one, the values' sequences, words and letters."""

    def __init__(self, column: pa.Array, normal: pa.Array | None = None):
        coded = column.dictionary_encode()
        self.at = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        keys = coded.dictionary.to_pylist()
        self.there = np.array([True] * len(keys) + [False])
        self.keys = [*keys, None]
        if normal is not None:
            first = {k: n for k, n in zip(self.at.tolist(), normal.to_pylist(), strict=True)}
            texts = [first.get(k) or "" for k in range(len(self.keys))]
        else:
            texts = [k or "" for k in self.keys]
        self.text = [t.strip(" ") for t in texts]
        self.words = [sorted({w for w in t.split(" ") if len(w) > 1} - _STOP) for t in texts]
        self._letters = self._twos = None

    def some(self, values: np.ndarray) -> _Field:
        """The same for some of the values."""
        out = object.__new__(_Field)
        out.there, out.keys = self.there[values], [self.keys[v] for v in values]
        out.text, out.words = [self.text[v] for v in values], [self.words[v] for v in values]
        out._letters, out._twos = self.letters()[values], [self.twos()[v] for v in values]
        return out

    def letters(self) -> np.ndarray:
        """How often each value has each of LETTERS; worked out once."""
        if self._letters is None:
            self._letters = np.zeros((len(self.text), len(LETTERS)), np.int16)
            for k, t in enumerate(self.text):
                for c in set(t):
                    self._letters[k, LETTERS.index(c)] = t.count(c)
        return self._letters

    def twos(self) -> list[list[str]]:
        if self._twos is None:
            self._twos = [_twos(t) for t in self.text]
        return self._twos


_STOP, _CUES = set(X.STOPWORDS), set(X.CUES)


def _equal(x: list, y: list) -> np.ndarray:
    """Which values are equal; nulls are too."""
    number: dict = {}
    a, b = (np.array([number.setdefault(v, len(number)) for v in s], dtype=np.int64) for s in (x, y))
    return a[:, None] == b


def _twos(text: str) -> list[str]:
    """The neighbouring letters of a text, numbered where they repeat."""
    seen: dict[str, int] = {}
    out = []
    for k in range(len(text) - 1):
        two = text[k : k + 2]
        seen[two] = seen.get(two, 0) + 1
        out.append(f"{two}{seen[two]}")
    return out


def _common(x: list[list[str]], y: list[list[str]]) -> np.ndarray:
    """How many words each two of the word lists share."""
    known = {w: k for k, w in enumerate({w for ws in x for w in ws} & {w for ws in y for w in ws})}
    if not known:
        return np.zeros((len(x), len(y)), np.int64)
    sides = [np.zeros((len(s), len(known)), np.float32) for s in (x, y)]
    for side, lists in zip(sides, (x, y), strict=True):
        for k, ws in enumerate(lists):
            side[k, [known[w] for w in ws if w in known]] = 1
    return (sides[0] @ sides[1].T).astype(np.int64)


class _Likeness:
    """Bounds of two blocks' values of one field: low and high likeness, whether sets or bounds make them the same."""

    def __init__(self, name: str, x: _Field, y: _Field):
        self.x, self.y = x, y
        both = x.there[:, None] & y.there
        shared = _common(x.words, y.words)
        nx, ny = (np.array([len(w) for w in s.words])[:, None] for s in (x, y))
        ny = ny.T
        some = (nx > 0) & (ny > 0)
        jaccard = np.where(some, shared / np.maximum(nx + ny - shared, 1), 0.0)
        containment = np.where(some, shared / np.maximum(np.minimum(nx, ny), 1), 0.0)
        self.sets = np.maximum(jaccard, containment)
        even = both & _equal(x.keys, y.keys) if name in ("subject", "predicate", "period") else np.zeros_like(both)
        lx, ly = x.letters(), y.letters()
        overlap = np.zeros(both.shape, np.int16)
        for c in range(len(LETTERS)):
            overlap += np.minimum(lx[:, c, None], ly[:, c])
        sizes = np.array([len(t) for t in x.text])[:, None] + np.array([len(t) for t in y.text])
        filled = np.array([bool(t) for t in x.text])[:, None] & np.array([bool(t) for t in y.text])
        # between two blocks a letter of either side is left over, so m letters in blocks share 3 * m - sizes - 1 neighbours at least
        twos = _common(x.twos(), y.twos())
        short = np.array([len(t) < matching.LONG for t in x.text])[:, None] & np.array([len(t) < matching.LONG for t in y.text])
        letters = np.where(short, np.minimum(overlap, (twos + sizes + 1) // 3), overlap)
        self.most, self.least = np.where(filled, 2.0 * letters / np.maximum(sizes, 1), 0.0), np.zeros(both.shape)
        self.even, self.both = even, both
        self.close = both & (even | (jaccard >= 0.40) | (containment >= 0.60))
        self.asked = np.argwhere(both & filled & ~even) if both.size <= FEW else np.zeros((0, 2), int)

    def asks(self) -> list[tuple[str, str]]:
        """The value pairs whose ratios are wanted before any pair of claims is looked at, in both directions."""
        both = [(self.x.text[i], self.y.text[j]) for i, j in self.asked.tolist()]
        return both + [(b, a) for a, b in both]

    def settle(self, ratio: np.ndarray) -> None:
        """Take the ratios of ``asks`` and fix the bounds."""
        i, j = self.asked.T
        ways = ratio[: len(i)], ratio[len(i) :]
        self.most[i, j], self.least[i, j] = np.maximum(*ways), np.minimum(*ways)
        bound = lambda r: np.where(self.even, 1.0, np.where(self.both, np.maximum(r, self.sets), 0.0))
        self.low, self.high = bound(self.least), bound(self.most)
        self.same_low, self.same_high = self.close | (self.both & (self.least >= 0.75)), self.close | (self.both & (self.most >= 0.75))

    def exact(self, i: np.ndarray, j: np.ndarray, forward: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likeness, and whether the values are the same, of values i and j; forward where i's claim comes first."""
        like, same = self.low[i, j], self.same_low[i, j]
        open_ = np.flatnonzero((like < self.high[i, j]) | (same != self.same_high[i, j]))
        if len(open_):
            one, back = np.unique(np.stack([i[open_], j[open_], forward[open_]]), axis=1, return_inverse=True)
            a = [self.x.text[p] if f else self.y.text[q] for p, q, f in one.T.tolist()]
            b = [self.y.text[q] if f else self.x.text[p] for p, q, f in one.T.tolist()]
            ratio = matching.ratios(a, b)[back.reshape(-1)]
            p, q = i[open_], j[open_]
            like[open_] = np.maximum(ratio, self.sets[p, q])
            same[open_] = self.close[p, q] | (ratio >= 0.75)
        return like, same


def _score(like: dict[str, np.ndarray], same: dict[str, np.ndarray], shared: np.ndarray, cues: np.ndarray, unit: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score, and the number of its reason. The weights are fixed values; sums run as in ``pairs.score``."""
    d, b, s, p = (like[f] for f in ("definition", "basis", "scope", "period"))
    most, cue = np.minimum(shared, 5), np.minimum(cues, 3)
    close = 70 + 12 * d + 5 * b + 5 * s + 8 * p + 1.5 * most + 3 * unit + 2 * kind
    related = 45 + 12 * like["predicate"] + 12 * d + 5 * b + 5 * s + 6 * p + 2 * most + 3 * cue + 2 * unit + kind
    context = SHARED[np.minimum(shared, 4)] + 12 * like["subject"] + 8 * like["predicate"] + 18 * d + 5 * b + 5 * s + 5 * p + 4 * cue + 2 * unit + kind
    reason = np.where(same["subject"], np.where(same["predicate"], 2, 1), 0)
    return np.choose(reason, [context, related, close]), reason


def _there(values: list) -> np.ndarray:
    return np.array([v is not None for v in values], dtype=bool)


def _wild(x: list, y: list) -> np.ndarray:
    """1 unless both are there and differ."""
    return (_equal(x, y) | ~_there(x)[:, None] | ~_there(y)).astype(float)


def _column(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class _Values:
    """What a score needs of the rows of a block."""

    def __init__(self, rows: pa.Table):
        column = lambda name: _column(rows, name)
        self.unit, self.kind = (column(c).to_pylist() for c in ("unit", "kind"))
        self.fields = {f: _Field(column(f)) if f != "period" else _Field(column("raw_period"), column("period")) for f in FIELDS}
        self.words = [w.split() for w in column("words").to_pylist()]


class _Side(_Values):
    """The same of claims, and what tells which pairs count."""

    def __init__(self, rows: pa.Table):
        super().__init__(rows)
        self.ord = _column(rows, "ord").to_numpy(zero_copy_only=False)
        self.doc, self.id = (_column(rows, c).to_pylist() for c in ("doc", "id"))


class _Kinds(_Values):
    """The same of kinds, and their members' first and last number."""

    def __init__(self, rows: pa.Table):
        super().__init__(rows)
        self.first, self.last = (_column(rows, c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
        self.members = _column(rows, "members")


class _Bounds:
    """Some rows of one block against all of another: bounds of all scores, and exact scores of some."""

    def __init__(self, x: _Values, y: _Values, rows: slice):
        self.x, self.y, self.start = x, y, rows.start
        self.fields, self.at = {}, {}
        for f in FIELDS:
            mine, theirs = x.fields[f], y.fields[f]
            used, at = np.unique(mine.at[rows], return_inverse=True)
            self.at[f] = at, theirs.at
            self.fields[f] = _Likeness(f, mine.some(used), theirs)
        # one call for all fields
        asks = {f: self.fields[f].asks() for f in FIELDS}
        ratio = matching.ratios([a for f in FIELDS for a, _ in asks[f]], [b for f in FIELDS for _, b in asks[f]])
        for f, part in zip(FIELDS, np.split(ratio, np.cumsum([len(asks[f]) for f in FIELDS])[:-1]), strict=True):
            self.fields[f].settle(part)
        words = x.words[rows]
        self.shared = _common(words, y.words)
        self.cues = _common([[w for w in ws if w in _CUES] for ws in words], [[w for w in ws if w in _CUES] for ws in y.words])
        self.unit, self.kind = _wild(x.unit[rows], y.unit), _wild(x.kind[rows], y.kind)

    def high(self) -> np.ndarray:
        """The upper bound of every pair's score."""
        spread = lambda m, f: m[self.at[f][0]][:, self.at[f][1]]
        like = {f: spread(self.fields[f].high, f) for f in FIELDS}
        same = {f: spread(self.fields[f].same_high, f) for f in ("subject", "predicate")}
        return _score(like, same, self.shared, self.cues, self.unit, self.kind)[0]

    def low(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The lower bound of some pairs' scores."""
        pick = lambda m, f: m[self.at[f][0][i], self.at[f][1][j]]
        like = {f: pick(self.fields[f].low, f) for f in FIELDS}
        same = {f: pick(self.fields[f].same_low, f) for f in ("subject", "predicate")}
        return _score(like, same, self.shared[i, j], self.cues[i, j], self.unit[i, j], self.kind[i, j])[0]

    def scores(self, i: np.ndarray, j: np.ndarray, forward: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and reason of some pairs; forward where i's claim comes first."""
        found = {f: self.fields[f].exact(self.at[f][0][i], self.at[f][1][j], forward) for f in FIELDS}
        return _score({f: v[0] for f, v in found.items()}, {f: v[1] for f, v in found.items()}, self.shared[i, j], self.cues[i, j], self.unit[i, j], self.kind[i, j])


class Strip(_Bounds):
    """The same of claims, whose pairs have one direction and may not count."""

    def __init__(self, x: _Side, y: _Side, rows: slice, one_block: bool):
        super().__init__(x, y, rows)
        ahead = x.ord[rows][:, None] < y.ord
        same_doc = _equal(x.doc[rows], y.doc) & _there(x.doc[rows])[:, None]
        self.same_claim = _equal(x.id[rows], y.id)
        self.apart = ~same_doc & (ahead if one_block else x.ord[rows][:, None] != y.ord)
        self.valid = self.apart & ~self.same_claim
        self.ahead = ahead

    def exact(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and reason of some pairs."""
        return self.scores(i, j, self.ahead[i, j])

    def rows(self, i: np.ndarray, j: np.ndarray, score: np.ndarray, reason: np.ndarray) -> dict[str, np.ndarray]:
        """The pairs' numbers, and their claims' places in x followed by y."""
        forward, i = self.ahead[i, j], i + self.start
        mine, theirs, place = self.x.ord[i], self.y.ord[j], j + len(self.x.ord)
        a, b = (np.where(forward, *s) for s in ((mine, theirs), (theirs, mine)))
        at_a, at_b = (np.where(forward, *s) for s in ((i, place), (place, i)))
        return {"ord_a": a, "ord_b": b, "at_a": at_a, "at_b": at_b, "score": score, "reason": reason}


def _candidates(strip: Strip, _seen: list) -> dict[str, np.ndarray]:
    """Every pair that reaches the threshold; no score where the bounds decide."""
    i, j = np.nonzero(strip.valid & (strip.high() >= THRESHOLD))
    kept = strip.low(i, j) >= THRESHOLD
    open_ = np.flatnonzero(~kept)
    kept[open_] = strip.exact(i[open_], j[open_])[0] >= THRESHOLD
    i, j = i[kept], j[kept]
    return strip.rows(i, j, np.full(len(i), np.nan), np.full(len(i), -1))


def _scores(strip: Strip, _seen: list) -> dict[str, np.ndarray]:
    """Every pair that reaches the threshold, with its score."""
    i, j = np.nonzero(strip.valid & (strip.high() >= THRESHOLD))
    score, reason = strip.exact(i, j)
    kept = score >= THRESHOLD
    return strip.rows(i[kept], j[kept], score[kept], reason[kept])


def _every(strip: Strip, _seen: list) -> dict[str, np.ndarray]:
    """Every pair of different documents, with its score; 0 for a pair of one claim or under the threshold."""
    i, j = np.nonzero(strip.apart)
    score, reason = np.zeros(len(i)), np.where(strip.same_claim[i, j], len(REASONS), len(REASONS) + 1)
    open_ = np.flatnonzero(strip.valid[i, j] & (strip.high()[i, j] >= THRESHOLD))
    found, why = strip.exact(i[open_], j[open_])
    kept = found >= THRESHOLD
    score[open_[kept]], reason[open_[kept]] = found[kept], why[kept]
    return strip.rows(i, j, score, reason)


def _best(top: int) -> Callable[[Strip, list], dict[str, np.ndarray]]:
    """The ``top`` best pairs of a strip; ``seen`` holds the best scores of the strips before."""

    def run(strip: Strip, seen: list) -> dict[str, np.ndarray]:
        high = strip.high()
        i, j = np.nonzero(strip.valid & (high >= THRESHOLD))
        known = np.concatenate([*seen, strip.low(i, j)])
        cut = max(THRESHOLD, float(np.partition(known, -top)[-top])) if len(known) > top else THRESHOLD
        some = high[i, j] >= cut
        i, j = i[some], j[some]
        score, reason = strip.exact(i, j)
        out = strip.rows(i, j, score, reason)
        order = np.lexsort((out["ord_b"], out["ord_a"], -score))
        order = order[score[order] >= cut][:top]
        best = np.concatenate([*seen, score[order]])
        seen[:] = [np.partition(best, -top)[-top:] if len(best) > top else best]
        return {name: c[order] for name, c in out.items()}

    return run


OUT = "session_id string, ord_a int, ord_b int, id_a string, id_b string, score double, reason string"


def _sides(key: tuple, table: pa.Table) -> tuple[_Side, _Side]:
    side = table.column("side").to_numpy()
    x = _Side(table.filter(pa.array(side == 0)))
    return x, x if key[1].as_py() == key[2].as_py() else _Side(table.filter(pa.array(side == 1)))


def _strips(pick: Callable, x: _Side, y: _Side) -> dict[str, np.ndarray]:
    """What ``pick`` takes of all strips of two blocks."""
    found, seen = [], []
    for at in range(0, len(x.ord), STRIP):
        found.append(pick(Strip(x, y, slice(at, min(at + STRIP, len(x.ord))), x is y), seen))
    return {name: np.concatenate([f[name] for f in found]) for name in found[0]}


def _columns(key: tuple, x: _Side, y: _Side, found: dict[str, np.ndarray]) -> list[pa.Array]:
    """session_id, ord_a, ord_b, id_a and id_b of pairs."""
    ids = pa.array(x.id + y.id, pa.string())
    ords = [pa.array(found[c].astype(np.int32)) for c in ("ord_a", "ord_b")]
    return [pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(ords[0])), *ords, *(ids.take(pa.array(found[c])) for c in ("at_a", "at_b"))]


def _met(pick: Callable) -> Callable[[tuple, pa.Table], pa.Table]:
    names = pa.array([*REASONS, "same_claim", "below_threshold", None])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, y = _sides(key, table)
        found = _strips(pick, x, y)
        score = found["score"]
        return pa.table([*_columns(key, x, y, found), pa.array(score, pa.float64(), mask=np.isnan(score)), names.take(pa.array(found["reason"] % len(names)))], OUT_NAMES)

    return run


OUT_NAMES = [field.split()[0] for field in OUT.split(", ")]
VERDICT = pa.struct([(f, pa.string()) for f in ("relationship_type", "reason_code", "explanation")] + [("confidence", pa.float64()), ("decided_by", pa.string())])
MEMBERS = pa.list_(pa.struct([("ord", pa.int32()), ("id", pa.string()), ("doc", pa.int32()), ("own", pa.int32())]))
LINKED = pa.schema([("session_id", pa.string()), ("a", MEMBERS), ("b", MEMBERS), ("verdict", VERDICT)])
LINKED_TYPE = (
    "session_id string, a array<struct<ord: int, id: string, doc: int, own: int>>, b array<struct<ord: int, id: string, doc: int, own: int>>, "
    "verdict struct<relationship_type: string, reason_code: string, explanation: string, confidence: double, decided_by: string>"
)


def _meeting(x: _Kinds, y: _Kinds) -> tuple[np.ndarray, np.ndarray]:
    """Places in x followed by y of each two kinds whose members are candidates where the first's claim is the earlier one."""
    found = []
    for at in range(0, len(x.first), STRIP):
        rows = slice(at, min(at + STRIP, len(x.first)))
        strip = _Bounds(x, y, rows)
        high = strip.high() >= THRESHOLD
        ways = [(True, x.first[rows][:, None] < y.last)]
        if x is not y:
            ways.append((False, y.first < x.last[rows][:, None]))
        for forward, possible in ways:
            i, j = np.nonzero(high & possible)
            kept = strip.low(i, j) >= THRESHOLD
            open_ = np.flatnonzero(~kept)
            kept[open_] = strip.scores(i[open_], j[open_], np.full(len(open_), forward))[0] >= THRESHOLD
            i, j = i[kept] + at, j[kept] + (0 if x is y else len(x.first))
            found.append((i, j) if forward else (j, i))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _numbered(members: pa.ListArray) -> pa.ListArray:
    """Members with numbers for document and id: null documents differ from all, null ids are equal."""
    values = members.flatten()
    doc, own = (values.field(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in ("doc", "id"))
    doc = np.where(np.isnan(doc), -1 - np.arange(len(doc)), doc).astype(np.int32)
    own = np.nan_to_num(own, nan=-1).astype(np.int32)
    structs = pa.StructArray.from_arrays([values.field("ord"), values.field("id").cast(pa.string()), pa.array(doc), pa.array(own)], fields=list(MEMBERS.value_type))
    sizes = members.value_lengths().to_numpy()
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), structs, type=MEMBERS)


def _lists(members: pa.Array, at: list[np.ndarray]) -> pa.Array:
    """Lists of the members at some places."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, members.take(pa.array(np.concatenate([np.zeros(0, np.int64), *at]))), type=MEMBERS)


def _without(sizes: tuple[int, int], i: np.ndarray, j: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Members of two kinds that make all pairs but (i, j): those of the first without such pairs together, each other on its own."""
    left = np.ones(sizes, bool)
    left[i, j] = False
    whole = left.all(axis=1)
    parts = [(np.array([k]), np.flatnonzero(left[k])) for k in np.flatnonzero(~whole).tolist()]
    parts.append((np.flatnonzero(whole), np.arange(sizes[1])))
    return [(p, q) for p, q in parts if len(p) and len(q)]


def _met_known(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
    """The members of each two kinds that are candidates, without stored pairs, with the kinds' known verdict."""
    if not table.num_rows:
        return LINKED.empty_table()
    side = table.column("side").to_numpy()
    x = _Kinds(table.filter(pa.array(side == 0)))
    y = x if key[1].as_py() == key[2].as_py() else _Kinds(table.filter(pa.array(side == 1)))
    all_ = x.members if x is y else pa.concat_arrays([x.members, y.members])
    members, n = _numbered(all_), len(all_)
    starts = members.offsets.to_numpy()
    sizes, ords = np.diff(starts), members.values.field("ord").to_numpy()
    order, row_of = np.argsort(ords), np.repeat(np.arange(n), sizes)
    stored = known.column("stored").to_numpy(zero_copy_only=False).astype(bool)
    at = [order[np.searchsorted(ords, known.column(c).to_numpy(), sorter=order)] for c in ("ord_a", "ord_b")]
    code = row_of[at[0]] * n + row_of[at[1]]
    a, b = _meeting(x, y)
    # each two kinds' row of known, -1 where there is none
    told = np.flatnonzero(~stored)
    told = np.append(told[np.argsort(code[told])], -1)
    codes = np.append(code[told[:-1]], n * n)
    spot = np.searchsorted(codes, a * n + b)
    row = np.where(codes[spot] == a * n + b, told[spot], -1)
    # kinds with stored pairs are taken apart
    gone = np.flatnonzero(stored)
    gone = gone[np.argsort(code[gone], kind="stable")]
    holed = np.isin(a * n + b, code[gone])
    parts, rows = [], []
    for p, q, r in zip(a[holed].tolist(), b[holed].tolist(), row[holed].tolist(), strict=True):
        some = gone[np.searchsorted(code[gone], p * n + q) : np.searchsorted(code[gone], p * n + q, side="right")]
        kept = _without((sizes[p], sizes[q]), at[0][some] - starts[p], at[1][some] - starts[q])
        parts += [(starts[p] + i, starts[q] + j) for i, j in kept]
        rows += [r] * len(kept)
    sides = [pa.concat_arrays([members.take(pa.array(s[~holed])), _lists(members.values, [part[k] for part in parts])]) for k, s in enumerate((a, b))]
    row = np.concatenate([row[~holed], np.array(rows, np.int64)])
    verdicts = _column(known, "verdict")
    verdicts = verdicts.cast(VERDICT).take(pa.array(row, mask=row < 0)) if len(verdicts) else pa.nulls(len(row), VERDICT)
    return pa.table([pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(row)), *sides, verdicts], schema=LINKED)


def placed(claims: DataFrame) -> DataFrame:
    """Claims (with ``ord``) of sessions with ``block`` and ``blocks``: claims of like predicate, period and subject lie together, so blocks hold few distinct values."""
    keys = {"_predicate": X.filled(F.col("n_predicate")), "_period": X.filled(F.col("period")), "_subject": X.filled(F.col("n_subject"))}
    alike = Window.partitionBy("session_id").orderBy(*keys, "ord")
    known = prepared(claims.filter("session_id is not null")).withColumns(keys).select(*claims.columns, *keys)
    blocked = known.withColumn("block", F.floor((F.row_number().over(alike) - 1) / BLOCK).cast("int")).drop(*keys)
    return blocked.withColumn("blocks", F.max("block").over(Window.partitionBy("session_id")) + 1)


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _copies(rows: DataFrame) -> DataFrame:
    """Rows with ``block`` and ``blocks`` once for each two blocks x and y that they meet in: in as many groups as their session has blocks."""
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    copies = rows.withColumn("other", F.explode(other)).drop("blocks")
    copies = copies.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).withColumn("side", (F.col("block") != F.col("x")).cast("int")).drop("block", "other")
    return copies.repartition(_tasks(rows), "session_id", "x", "y")


def _meet(claims: DataFrame, pick: Callable) -> DataFrame:
    """Each two blocks of a session in one group."""
    return _copies(narrow(placed(claims), "block", "blocks")).groupBy("session_id", "x", "y").applyInArrow(_met(pick), OUT)


def kinds(claims: DataFrame, prepare: Callable, *also: str) -> DataFrame:
    """A row for up to ``MANY`` claims (with ``ord``) of a session that are equal in what a score needs and in columns ``also`` of ``prepare``.

    It holds these, ``members`` (ord, id, doc) in order, the ``first`` and ``last`` ord of them, ``block`` and ``blocks``.
    """
    # a session's claims come from one task; their texts are normalised in many
    tasks = 4 * claims.sparkSession.sparkContext.defaultParallelism
    known = narrow(prepare(claims.repartition(tasks, "session_id", "ord")), *also)
    same = [c for c in known.columns if c not in ("ord", "id", "doc")]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("ord"))
    # no row fills more than a block, so no block is left empty
    many = min(MANY, LEAST * BLOCK)
    rows = known.withColumn("_part", F.floor((nth - 1) / many)).groupBy(*same, "_part").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "doc"))).alias("members"))
    rows = rows.drop("_part").withColumns({"first": F.element_at("members", 1)["ord"], "last": F.element_at("members", -1)["ord"]})
    weight = F.greatest(F.size("members"), F.lit(LEAST))
    before = F.sum(weight).over(Window.partitionBy("session_id").orderBy("predicate", "raw_period", "subject", "first")) - weight
    blocked = rows.withColumn("block", F.floor(before / (LEAST * BLOCK)).cast("int"))
    return blocked.withColumn("blocks", F.max("block").over(Window.partitionBy("session_id")) + 1)


def linked(kinds: DataFrame, known: DataFrame) -> DataFrame:
    """session_id, a, b, verdict: members of ``kinds`` whose pairs are candidates and not stored, for ``expanded``.

    ``known`` has session_id, ord_a, ord_b, their kinds' block_a and block_b, and ``stored``. A stored pair is one of claims;
    else the two are the first of their kinds, and ``verdict`` holds for their members' pairs whose claim of the first kind is earlier.
    """
    pairs = known.select(F.col("session_id").alias("session"), "ord_a", "ord_b", "stored", "verdict", F.least("block_a", "block_b").alias("x"), F.greatest("block_a", "block_b").alias("y"))
    dealt = pairs.repartition(_tasks(kinds), "session", "x", "y").groupBy("session", "x", "y")
    needed = kinds.select("session_id", "first", "last", "members", *FIELDS, "raw_period", "words", "unit", "kind", "block", "blocks")
    return _copies(needed).groupBy("session_id", "x", "y").cogroup(dealt).applyInArrow(_met_known, LINKED_TYPE)


def expanded(found: DataFrame) -> DataFrame:
    """session_id, ord_a, ord_b, id_a, id_b, verdict: the pairs of ``linked`` members, the earlier claim first, of different documents and claims."""
    side = lambda s: F.inline(s).alias(*(f"{c}_{s}" for c in ("ord", "id", "doc", "own")))
    pairs = found.select("session_id", "verdict", "b", side("a")).select("session_id", "verdict", "ord_a", "id_a", "doc_a", "own_a", side("b"))
    return pairs.filter("ord_a < ord_b and doc_a <> doc_b and own_a <> own_b").select("session_id", "ord_a", "ord_b", "id_a", "id_b", "verdict")


def find(claims: DataFrame) -> DataFrame:
    """session_id, ord_a, ord_b, id_a, id_b of every pair of ``claims`` (with ``ord``) whose score is above 0."""
    return _meet(claims, _candidates).drop("score", "reason")


def scored(claims: DataFrame) -> DataFrame:
    """The same with ``score`` and ``reason``."""
    return _meet(claims, _scores)


def every(claims: DataFrame) -> DataFrame:
    """All pairs of different documents of each session, with ``score`` and ``reason`` as ``pairs.pair_scores`` gives them."""
    return _meet(claims, _every)


def best(claims: DataFrame, top: int = TOP) -> DataFrame:
    """The best-scored pairs of each session with ``rank``, ties in pair order: at most ``top`` leave two blocks' task."""
    order = Window.partitionBy("session_id").orderBy(F.desc("score"), "ord_a", "ord_b")
    return _meet(claims, _best(top)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
