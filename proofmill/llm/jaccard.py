"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, and its components.

A document's set holds its distinct five-word shingles as 64-bit hashes. Equal sets
form a class first, and only classes are joined. Tokens are ordered by frequency
(those that a task meets in two or more classes come last, the commonest at the
end), then by hash; the order decides cost only, never the result.

* Light sets, of at most ``boundary`` tokens: two sets that link share two tokens of
  their prefixes of size - ceil(0.8 size) + 2, so all two-token subsets of that
  prefix are their signatures.
* Heavy sets: they share one token of the prefixes of size - ceil(0.8 size) + 1,
  whose inverted lists are scanned. Light sets that a heavy one can reach are in
  these lists too.

The boundary is the size with the least cost over the counted sizes: subsets on one
side, list entries and the mean length of prefix tokens' lists on the other.

Within a list, pairs must agree in length and in position (enough tokens left after
the common one), then a parity bitmap as long as the set bounds the difference from
below; no pair that links is lost. Lists of up to ``SMALL`` sets give their pairs,
longer ones spanning forests of the pairs that pass. A family of near copies recurs in
many long lists: where these hold many pairs, each set goes to its longest list only,
what has been connected counts as one, and lists whose members all are connected drop
out; this repeats while it halves the pairs, and all pairs that are left, of unconnected
sets, are compared at last. The candidates' components hold every link: their exact sets meet there, and each pair of different sets is counted
once, as a link of both or not. Long lists and large components are dealt into
blocks by a hash, and each pair of blocks is a task's group of bounded size, so
neither is gathered in one place. Links are counted where they are found and never
put out pair by pair; the links themselves leave a task as a spanning forest.

Null texts are empty; a text without words has an empty set and links with nothing.
With fewer than five words the whole sequence is the one shingle. Repeated rows link
with each other and are each returned. Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import memo
from proofmill.llm.components import components, popcount
from proofmill.llm.shared import drop_written, maybe_broadcast, table, written
from proofmill.llm.vec import SPACED, U64, mix, slices, window_hash, words

WIDTH = 5
SMALL = 16
PAIRS = 1 << 21  # pairs in long lists that one pass compares; more are thinned out in rounds first
HOT_TOKENS = 1 << 18
LIST_BLOCK = 256  # sets of a long list in a block
SET_BLOCK, TOKEN_BLOCK = 512, 1 << 20  # sets and tokens of a component in a block
COLUMNS = 4096  # tokens that are compared at once
IDS = 4_000_000


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words(column, SPACED, lower=True)
    n = len(column)
    h, at = window_hash(w["hash"], w["doc"], width)
    bounds = np.searchsorted(w["doc"][at], np.arange(n + 1))
    first = np.searchsorted(w["doc"], np.arange(n + 1))
    out = []
    for d in range(n):
        if bounds[d] < bounds[d + 1]:
            out.append(np.unique(h[bounds[d] : bounds[d + 1]]))
        elif first[d] < first[d + 1]:
            own = w["hash"][first[d] : first[d + 1]]
            out.append(window_hash(own, np.zeros(len(own)), len(own))[0])
        else:
            out.append(np.zeros(0, U64))
    return out


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = mix(tokens ^ U64(0xA5A5A5A5)), mix(tokens + U64(0x123456789))
    n = np.array([len(tokens)], U64)
    return int(mix(n + a.sum(dtype=U64)).view(np.int64)[0]), int(mix(n ^ b.sum(dtype=U64)).view(np.int64)[0])


def needed(size: int) -> int:
    """Tokens that a set of this size shares with any set that links with it."""
    return -(-4 * size // 5)


def links(a: int, b: int, shared: int) -> bool:
    return 100 * shared >= 80 * (a + b - shared)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parities of token counts per bit; a power of two of at least as many bits as tokens."""
    bits = 64
    while bits < len(tokens):
        bits *= 2
    odd = np.bincount((mix(tokens) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64)


def fold(words_: np.ndarray, length: int) -> np.ndarray:
    while len(words_) > length:
        half = len(words_) // 2
        words_ = words_[:half] ^ words_[half:]
    return words_


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, n) ^ fold(y, n)).sum())


def may_link(a: int, b: int, difference: int) -> bool:
    """Whether sets of these sizes that differ in at least so many tokens can link: shared = (a + b - difference) / 2."""
    return 9 * (a + b - difference) >= 8 * (a + b)


def prefix_list_length(total: int, lengths: dict[int, int]) -> float:
    """The mean list length over the rarest fifth of all token occurrences, from which prefixes are made.

    ``lengths`` counts the frequent tokens by frequency; other tokens count as met once.
    """
    room = max(1.0, 0.2 * total)
    rare = min(room, max(0, total - sum(n * k for n, k in lengths.items())))
    used, weighed = float(rare), float(rare)
    for n in sorted(lengths):
        take = min(room - used, n * lengths[n])
        if take <= 0:
            break
        used, weighed = used + take, weighed + take * n
    return weighed / max(1.0, used)


def boundary(sizes: dict[int, int], mean_list: float) -> int:
    """The largest light size, by the least total cost."""
    order = sorted(s for s in sizes if s >= 4)
    heavy = {s: sizes[s] * (s - needed(s) + 1) * (1 + mean_list) for s in order}
    bridge = {s: sizes[s] * (s - needed(s) + 1) for s in order}
    light, left = 0.0, sum(heavy.values())
    best, cost = 3, left
    for s in order:
        light += sizes[s] * comb(s - needed(s) + 2, 2)
        left -= heavy[s]
        total = light + left + sum(bridge[x] for x in order if 0.8 * (s + 1) <= x <= s)
        if total < cost:
            best, cost = s, total
        if light > cost:
            break
    return best


def survey(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Frequent tokens (sorted), their ranks, and the boundary of light sets, from all documents."""

    @memo.task()
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sizes, held, total = set(), {}, [], 0

        def tokens(parts: list) -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            keys, n = keys[n > 1], n[n > 1]
            return pa.record_batch({"size": pa.array([None] * len(keys), pa.int64()), "token": pa.array(keys.view(np.int64)), "n": pa.array(n)})

        for batch in batches:
            for part in slices(batch):
                for s in shingle_sets(part.column("text")):
                    name = digest(s)
                    if name in seen:
                        continue
                    seen.add(name)
                    sizes[len(s)] = sizes.get(len(s), 0) + 1
                    held.append(s)
                    total += len(s)
            if total > 4_000_000:
                yield tokens(held)
                held, total, seen = [], 0, set()
        if held:
            yield tokens(held)
        yield pa.record_batch({"size": pa.array(list(sizes), pa.int64()), "token": pa.array([None] * len(sizes), pa.int64()), "n": pa.array(list(sizes.values()), pa.int64())})

    found = written(docs.select("text").mapInArrow(look, "size long, token long, n long").groupBy("size", "token").agg(F.sum("n").alias("n")), "survey")
    sizes = {r["size"]: r.n for r in found.filter("size is not null").collect()}  # a row per size
    frequent = found.filter("token is not null")
    lengths = {r.n: r["count"] for r in frequent.groupBy("n").count().collect()}  # a row per frequency
    top = frequent.orderBy(F.desc("n"), "token").limit(HOT_TOKENS).select("token", "n").toArrow()
    keys, n = top.column("token").to_numpy().astype(np.int64).view(U64), top.column("n").to_numpy().astype(np.int64)
    drop_written(docs.sparkSession, found)
    order = np.argsort(keys)
    return keys[order], n[order], boundary(sizes, prefix_list_length(sum(s * n for s, n in sizes.items()), lengths))


def signatures(tokens: np.ndarray, keys: np.ndarray, ranks: np.ndarray, light: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens for the inverted lists, in order, and hashes of two-token subsets."""
    size, none = len(tokens), np.zeros(0, U64)
    if size < 4:  # such a set links with equal sets only
        return none, none
    rank = np.zeros(size, np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
        rank = np.where(keys[at] == tokens, ranks[at], 0)
    ordered = tokens[np.lexsort((tokens, rank))]
    spare = size - needed(size)
    lists = ordered[: spare + 1] if size > light or 5 * size >= 4 * (light + 1) else none
    if size > light:
        return lists, none
    p = ordered[: spare + 2]
    i, j = np.triu_indices(len(p), 1)
    return lists, mix(mix(np.minimum(p[i], p[j]) + U64(77)) ^ np.maximum(p[i], p[j]))


def described(docs: DataFrame, keys: np.ndarray, ranks: np.ndarray, light: int, passing: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the long columns ``passing``, n, d1, d2, bits, lists, subsets."""
    shared = docs.sparkSession.sparkContext.broadcast((keys, ranks))

    @memo.task()
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = shared.value
        for batch in batches:
            for part in slices(batch):
                rows = []
                for s in shingle_sets(part.column("text")):
                    lists, subsets = signatures(s, keys, ranks, light)
                    rows.append((len(s), *digest(s), bitmap(s).tobytes(), lists.view(np.int64), subsets.view(np.int64)))
                n, d1, d2, bits, lists, subsets = zip(*rows, strict=True)
                yield pa.record_batch({c: part.column(c) for c in ("doc_id", *passing)} | {"n": pa.array(n, pa.int64()), "d1": pa.array(d1, pa.int64()), "d2": pa.array(d2, pa.int64()), "bits": pa.array(bits, pa.binary()), "lists": pa.array(lists, pa.list_(pa.int64())), "subsets": pa.array(subsets, pa.list_(pa.int64()))})

    out = docs.select("doc_id", *passing, "text").mapInArrow(describe, "".join(f"{c} long, " for c in ("doc_id", *passing)) + "n long, d1 long, d2 long, bits binary, lists array<long>, subsets array<long>")
    return written(out.withColumn("rid", F.monotonically_increasing_id()), "described")


def _pairs_of(cls: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of one list that agree in length and position; pos is -1 in lists of subsets."""
    i, j = np.triu_indices(len(cls), 1)
    need = -(-4 * (n[i] + n[j]) // 9)
    ok = (need <= np.minimum(n[i], n[j])) & (cls[i] != cls[j])
    ok &= (pos[i] < 0) | (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
    return i[ok], j[ok]


@memo.task()
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sig: pairs (a, b) of lists of up to SMALL sets, members (sig set) of longer ones."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])
    empty = np.zeros(0, np.int64)
    pairs: list[np.ndarray] = []
    n_pairs = 0

    def flush() -> pa.RecordBatch:
        p = np.unique(np.concatenate(pairs), axis=0)
        none = pa.nulls(len(p), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), none, none, none], schema=schema)

    held = {c: empty for c in ("sig", "cls", "n", "pos")}
    open_long = None  # the sig of a long list whose first rows are out
    for batch in _with_end(batches):
        new = {c: np.concatenate([held[c], batch.column(c).to_numpy()]) if batch is not None else held[c] for c in held}
        sig = new["sig"]
        if not len(sig):
            continue
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        ends = np.append(starts[1:], len(sig))
        size = ends - starts
        last = batch is not None  # the last list may go on
        long = size > SMALL
        if open_long is not None and sig[0] == open_long:
            long[0] = True
        out = np.zeros(len(sig), bool)
        for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            out[s:e] = True
        closed = np.ones(len(starts), bool)
        if last:
            closed[-1] = False
        open_long = int(sig[-1]) if last and long[-1] else None
        two = starts[closed & ~long & (size == 2)]
        if len(two):
            n, pos, cls = new["n"], new["pos"], new["cls"]
            need = -(-4 * (n[two] + n[two + 1]) // 9)
            ok = (need <= np.minimum(n[two], n[two + 1])) & (cls[two] != cls[two + 1])
            ok &= (pos[two] < 0) | (np.minimum(n[two] - pos[two], n[two + 1] - pos[two + 1]) >= need)
            two = two[ok]
            pairs.append(np.sort(np.column_stack([cls[two], cls[two + 1]]), axis=1))
            n_pairs += len(two)
        for k in np.flatnonzero(closed & ~long & (size > 2)).tolist():
            s, e = starts[k], ends[k]
            i, j = _pairs_of(new["cls"][s:e], new["n"][s:e], new["pos"][s:e])
            if len(i):
                pairs.append(np.sort(np.column_stack([new["cls"][s:e][i], new["cls"][s:e][j]]), axis=1))
                n_pairs += len(i)
        if out.any():
            none = pa.nulls(int(out.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(new["cls"][out]), none, pa.array(sig[out]), pa.array(new["n"][out]), pa.array(new["pos"][out])], schema=schema)
        keep = slice(starts[-1], len(sig)) if last and not long[-1] else slice(len(sig), len(sig))
        held = {c: v[keep] for c, v in new.items()}
        if n_pairs > 500_000:
            yield flush()
            pairs, n_pairs = [], 0
    if n_pairs:
        yield flush()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def block_pairs(rows: DataFrame, key: str, blocks: DataFrame, member: str) -> DataFrame:
    """Rows dealt to the pairs (x, y) of blocks of their key, each in ``own``; ``blocks`` (key, blocks) lists the keys with several."""
    held = rows.join(maybe_broadcast(blocks, IDS), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = held.withColumn("own", F.pmod(F.xxhash64(member, F.lit("block")), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    return dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("blocks", "other")


def _spanning(linked: np.ndarray, names: np.ndarray) -> tuple[list, list]:
    """Edges that connect what a symmetric truth table links."""
    group = np.arange(len(names))
    a, b = [], []
    for i in range(len(names)):
        js = np.flatnonzero(linked[i])
        while len(js := js[group[js] != group[i]]):
            group[group == group[js[0]]] = group[i]
            a.append(int(names[i]))
            b.append(int(names[js[0]]))
    return a, b


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], more: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Runs of rows with equal ``names``, which the rows are sorted by; each row has the columns ``more``."""
    held, last = [], None
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
        for key, *row in zip(keys, *(batch.column(c).to_pylist() if not pa.types.is_list(batch.schema.field(c).type) else _arrays(batch.column(c)) for c in more), strict=True):
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(tuple(row))
    if held:
        yield held


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    flat, offsets = column.flatten().to_numpy(), np.asarray(column.offsets)
    offsets = (offsets - offsets[0]).tolist()
    return [flat[a:b].copy() for a, b in zip(offsets, offsets[1:])]  # noqa: B905


@memo.task()
def _long_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, x, y, own, cls, n, pos, root, bits) sorted by sig, x, y: spanning forests of the pairs of a list that have different roots and pass all bounds."""
    for rows in _groups(batches, ("sig", "x", "y"), ("n", "cls", "pos", "own", "root", "bits")):
        rows.sort(key=lambda r: r[:2])
        n, cls, pos, own, root = (np.array([r[k] for r in rows], np.int64) for k in range(5))
        maps = [np.frombuffer(r[5], U64) for r in rows]
        width = np.array([len(x) for x in maps])
        across = own.min() != own.max()
        names, often = np.unique(root, return_counts=True)
        # sets of the commonest root meet the others from the others' side
        common = root == names[np.argmax(often)]
        ok = np.zeros((len(rows), len(rows)), bool)
        for i in np.flatnonzero(~common).tolist():
            j = np.arange(np.searchsorted(n, -(-4 * n[i] // 5)), np.searchsorted(n, n[i] * 5 // 4, "right"))
            j = j[(root[j] != root[i]) & (common[j] | (j > i))]
            if across:
                j = j[own[j] != own[i]]
            need = -(-4 * (n[i] + n[j]) // 9)
            fits = need <= np.minimum(n[i], n[j])
            if pos[i] >= 0:
                fits &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
            j = j[fits]
            for w in np.unique(np.minimum(width[j], width[i])).tolist():
                xs = j[np.minimum(width[j], width[i]) == w]
                mine, other = fold(maps[i], w), np.stack([fold(maps[x], w) for x in xs.tolist()])
                xs = xs[9 * (n[i] + n[xs] - popcount(other ^ mine)) >= 8 * (n[i] + n[xs])]
                ok[i, xs] = ok[xs, i] = True
        a, b = _spanning(ok, cls)
        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


@memo.task()
def _bits_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, na, nb, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "xa", "xb"))
        ok = [may_link(na[k], nb[k], least_difference(np.frombuffer(x[k], U64), np.frombuffer(y[k], U64))) for k in range(len(a))]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def candidates(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between classes such that two that link are connected. ``sets``: cls, n, bits, lists, subsets."""
    in_lists = sets.filter("size(lists) > 0").select("cls", "n", F.posexplode("lists").alias("pos", "sig"))
    in_subsets = sets.filter("size(subsets) > 0").select("cls", "n", F.lit(-1).alias("pos"), F.explode("subsets").alias("sig"))
    postings = in_lists.unionByName(in_subsets).select("sig", "cls", "n", F.col("pos").cast("long").alias("pos"))
    found = written(postings.repartition("sig").sortWithinPartitions("sig").mapInArrow(_scan, "a long, b long, sig long, n long, pos long"), "lists")
    bits = sets.select("cls", "n", "bits")
    pairs = found.filter("sig is null").select("a", "b").distinct()
    with_bits = pairs.join(bits.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a").join(bits.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b")
    short = with_bits.mapInArrow(_bits_pass, "a long, b long")
    members = found.filter("sig is not null").select("sig", F.col("a").alias("cls"), "n", "pos")
    edges = written(short.filter("a <> b"), "candidates")
    rooted, before = members.withColumn("root", F.col("cls")), float("inf")
    while True:
        lists = written(_open_lists(rooted), "open")
        left = lists.agg(F.sum("pairs")).first()[0] or 0.0
        if left <= PAIRS or 2 * left > before:
            break
        before = left
        # sets that look alike have most lists in common, so most of them meet in one; it need not be that of
        # their first common token, which the bound by position asks for
        chosen = rooted.join(maybe_broadcast(lists, IDS), "sig").groupBy("cls").agg(F.max(F.struct("size", "sig")).alias("x")).select("cls", F.col("x.sig").alias("sig"))
        met = rooted.join(chosen, ["cls", "sig"]).withColumn("pos", F.lit(-1).cast("long"))
        edges = written(edges.unionByName(_compared(met, bits)), "candidates")
        roots = components(edges).withColumnRenamed("node", "cls")
        rooted = written(members.join(maybe_broadcast(roots, IDS), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "rooted")
    last = _compared(rooted.join(maybe_broadcast(lists.select("sig"), IDS), "sig"), bits)
    return written(edges.unionByName(last).distinct(), "candidates", found)


def _open_lists(rooted: DataFrame) -> DataFrame:
    """sig, size, pairs: the lists with members that nothing connects yet, and how many pairs of these they hold."""
    by_root = rooted.groupBy("sig", "root").agg(F.count("*").cast("double").alias("c"))
    return by_root.groupBy("sig").agg(F.sum("c").alias("size"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs")).filter("pairs > 0")


def _compared(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the members of each list (sig, cls, n, pos, root) which pass all bounds and have different roots."""
    blocks = rows.groupBy("sig").agg(F.ceil(F.count("*") / LIST_BLOCK).alias("blocks")).filter("blocks > 1")
    dealt = block_pairs(rows.join(bits.select("cls", "bits"), "cls"), "sig", written(blocks, "long"), "cls")
    return dealt.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y").mapInArrow(_long_lists, "a long, b long")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many tokens each of the sets ``left`` shares with each of ``right`` (None: the same sets)."""
    sets = left + (right or [])
    split, k = len(left), len(sets)
    if k <= 6:
        out = np.zeros((split, len(right) if right else split), np.int64)
        for i in range(split):
            for j in range(i + 1, split) if right is None else range(len(right)):
                out[i, j] = len(np.intersect1d(left[i], (right or left)[j], assume_unique=True))
        return out if right is not None else out + out.T
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = often[token] > 1
    owner, token, often = owner[again], token[again], often[often > 1]
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    first = np.concatenate([[0], np.cumsum(often)])
    out = np.zeros((split, k - split if right is not None else split), np.float32)
    if float((often.astype(float) ** 2).sum()) * 200 < float(len(often)) * k * k:
        # few sets per token: its pairs one by one
        for n in np.unique(often).tolist():
            some = first[:-1][often == n]
            if n > 1:
                i, j = np.triu_indices(n, 1)
                for part in np.array_split(some, max(1, len(some) * len(i) // 1_000_000)):
                    p, q = owner[part[:, None] + i].ravel(), owner[part[:, None] + j].ravel()
                    if right is None:
                        out += np.bincount(p * k + q, minlength=k * k).reshape(k, k)
                    else:
                        mixed = (p < split) & (q >= split)
                        out += np.bincount(p[mixed] * (k - split) + q[mixed] - split, minlength=out.size).reshape(out.shape)
        return (out if right is not None else out + out.T).astype(np.int64)
    for at in range(0, len(often), COLUMNS):
        end = min(len(often), at + COLUMNS)
        table_ = np.zeros((k, end - at), np.float32)
        table_[owner[first[at] : first[end]], token[first[at] : first[end]] - at] = 1
        out += table_[:split] @ (table_[split:] if right is not None else table_).T
    return np.rint(out).astype(np.int64)


@memo.task()
def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, x, y, own, cls, copies, tokens) sorted by bucket, x, y, cls: (cls, null, documents linked with) and edges (a, b, 0) that connect all links."""
    out: tuple[list, list, list] = ([], [], [])
    for rows in _groups(batches, ("bucket", "x", "y"), ("own", "cls", "copies", "tokens")):
        rows = [r for k, r in enumerate(rows) if k == 0 or r[1] != rows[k - 1][1]]  # a class of repeated rows comes once
        low = min(r[0] for r in rows)
        here, there = [r for r in rows if r[0] == low], [r for r in rows if r[0] != low]
        if len(rows) < 2:
            continue
        size = lambda rs: np.array([len(r[3]) for r in rs])
        copies = lambda rs: np.array([r[2] for r in rs], np.int64)
        other = there or here
        shared = shared_counts([r[3] for r in here], [r[3] for r in there] if there else None)
        linked = 100 * shared >= 80 * (size(here)[:, None] + size(other)[None, :] - shared)
        if not there:
            np.fill_diagonal(linked, False)
        counts = list(zip(here, (linked @ copies(other)).tolist(), strict=True))
        if there:
            counts += zip(there, (linked.T @ copies(here)).tolist(), strict=True)
            whole = np.zeros((len(rows), len(rows)), bool)
            whole[: len(here), len(here) :] = linked
            linked = whole | whole.T
        a, b = _spanning(linked, np.array([r[1] for r in here + there]))
        counts = [(r[1], n) for r, n in counts if n]
        for column, new in zip(out, (a + [c for c, _ in counts], b + [None] * len(counts), [0] * len(a) + [n for _, n in counts]), strict=True):
            column += new
        if len(out[0]) > 100_000:
            yield _link_rows(out)
            out = ([], [], [])
    yield _link_rows(out)


def _link_rows(rows: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.record_batch({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "links"), rows, strict=True)})


def linked(docs: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, links: edges (a, b) of classes whose exact sets link, connecting all that do; where b is null, how many documents of other classes ``a`` links with."""
    bucket = written(components(edges).join(classes.select(F.col("cls").alias("node"), "n", "d1", "d2", "doc_id", "copies"), "node"), "buckets")
    blocks = bucket.groupBy(F.col("root").alias("bucket")).agg(F.ceil(F.greatest(F.count("*") / SET_BLOCK, F.sum("n") / TOKEN_BLOCK)).alias("blocks")).filter("blocks > 1")

    @memo.task()
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                names = [digest(s) for s in sets]
                yield pa.record_batch({"d1": pa.array([x for x, _ in names], pa.int64()), "d2": pa.array([x for _, x in names], pa.int64()), "tokens": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    ids = bucket.select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(maybe_broadcast(ids, IDS), "doc_id", "left_semi")
    named = bucket.select("d1", "d2", F.col("node").alias("cls"), F.col("root").alias("bucket"), "copies")
    sets = texts.mapInArrow(sets_of, "d1 long, d2 long, tokens array<long>").join(maybe_broadcast(named, IDS), ["d1", "d2"])
    dealt = block_pairs(sets.select("bucket", "cls", "copies", "tokens"), "bucket", written(blocks, "large"), "cls")
    return written(dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "cls").mapInArrow(_count_links, "a long, b long, links long"), "links")


def near_rows(docs: DataFrame, passing: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, the long columns ``passing``, n_shingles, component_id, n_links, root.

    ``n_links`` counts the other rows that a row links with. ``root`` names the component,
    also where a doc_id recurs in several; it is null for an empty set.
    """
    keys, ranks, light = survey(docs)
    info = described(docs, keys, ranks, light, passing)
    narrow = info.select("rid", "doc_id", *passing, "n", "d1", "d2")
    classes = written(narrow.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("rid").alias("cls"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "classes")
    copies = narrow.join(maybe_broadcast(classes.filter("copies > 1").select("n", "d1", "d2", "cls"), IDS), ["n", "d1", "d2"]).filter("rid <> cls").select("rid")
    sets = info.filter("n >= 4").join(maybe_broadcast(copies, IDS), "rid", "left_anti").withColumnRenamed("rid", "cls")
    found = linked(docs, classes, candidates(sets))
    roots = components(found.filter("b is not null")).withColumnRenamed("node", "cls")
    counts = found.filter("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    # only components of several classes have a least doc_id to look up, and a large one is met as a row for each task
    least = written(roots.join(classes.select("cls", "doc_id"), "cls").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    joined = classes.join(roots, "cls", "left").join(counts, "cls", "left").join(maybe_broadcast(least, IDS), "root", "left")
    named = written(joined.select("n", "d1", "d2", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("root", "cls").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named", least)
    whole = narrow.join(named, ["n", "d1", "d2"], "left")
    return whole.select("doc_id", *passing, F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, n_links."""
    return near_rows(docs).drop("root")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
