"""Quality rules with a modified Kneser-Ney character model per language.

Spark counts the 4-grams of characters of the reference documents (those labelled
good; of a language without such documents, all) and derives, by grouping alone,
the continuation counts of the lower orders, the three discounts per order and
language, and the interpolated probabilities and backoff weights. The model stays a
table and whole: joins give each distinct 4-gram of the documents its probability.
Up to ``HELD`` of these go out as arrays sorted by 64-bit hash, in which a look-up
starts at the bucket of the hash's top bits; more are joined to the counted 4-grams
of each document. Both ways use the same values.

A document's perplexity is taken over all its 4-grams. Each language has a lower
and an upper band, from the quantiles of all its documents; documents outside are
rejected. A language without a model and a text of under four characters have no
perplexity and pass. Null texts are empty; null languages count as one language
of their own. Characters beyond the 16-bit plane count as one character. Repeated
rows are scored each; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import memo
from proofmill.llm.shared import at_most, maybe_broadcast, table, written
from proofmill.llm.vec import SPACED, U64, mix, runs, slices, span_hash, text_buffers, window_hash

ORDER = 4
HELD = 2_000_000  # 4-grams with their probabilities in a broadcast; more are joined
LOW = 200_000  # entries of a lower order in a broadcast
BAND = 10.0  # times the distance between the quartiles, on either side of the median
NARROWEST = 0.02  # that the distance counts as, at least
NO_LANG = ""
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
MASKS = {n: (1 << 16 * n) - 1 for n in range(1, ORDER)}


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """16-bit characters of a text column and the documents' offsets."""
    data, offs = text_buffers(column)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(points > 0xFFFF, 0xFFFD, points).astype(U64), lead[offs]


def grams(points: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-grams as 64-bit numbers, and each one's document."""
    n = len(points) - ORDER + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    key = (points[:n] << U64(48)) | (points[1 : n + 1] << U64(32)) | (points[2 : n + 2] << U64(16)) | points[3:]
    inside = doc[:n] == doc[ORDER - 1 :]
    return key[inside], doc[:n][inside]


def by_language(part: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Rows of each language."""
    langs = pc.fill_null(part.column("lang"), NO_LANG)
    codes = langs.dictionary_encode()
    index = np.asarray(codes.indices)
    for k, name in enumerate(codes.dictionary.to_pylist()):
        yield name, np.flatnonzero(index == k)


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all of ``docs``; tasks sum what they can before the shuffle."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n, first)

    def rows(lang: str, parts: list) -> pa.RecordBatch:
        keys, n = merged(parts)
        return pa.record_batch({"lang": pa.array([lang] * len(keys), pa.string()), "gram": pa.array(keys.view(np.int64)), "n": pa.array(n)})

    @memo.task()
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch):
                for lang, at in by_language(part):
                    keys, _ = grams(*characters(part.column("text").take(pa.array(at))))
                    if not len(keys):
                        continue
                    keys, n = np.unique(keys, return_counts=True)
                    held.setdefault(lang, []).append((keys, n))
                    size[lang] = size.get(lang, 0) + len(keys)
                    if size[lang] > 2_000_000:
                        held[lang] = [merged(held[lang])]
                        size[lang] = len(held[lang][0][0])
                        if size[lang] > 1_500_000:
                            yield rows(lang, held.pop(lang))
                            size[lang] = 0
        for lang, parts in held.items():
            yield rows(lang, parts)

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> DataFrame:
    """Per language the modified Kneser-Ney discounts d1, d2, d3 of one order."""
    n = [F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in range(1, 5)]
    y = "n1 / greatest(n1 + 2 * n2, 1)"
    clamp = lambda k: f"least({k}D, greatest(0D, coalesce({k} - {k + 1} * ({y}) * n{k + 1} / nullif(n{k}, 0), {k} * 0.5D)))"
    return counts.groupBy("lang").agg(*n).selectExpr("lang", *[f"{clamp(k)} AS d{k}" for k in (1, 2, 3)])


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log probabilities (lang, size, gram, n, logp) and log backoff weights (lang, size, gram, logb) of all orders.

    ``size`` is the number of characters in ``gram``.
    """
    levels = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):
        upper = levels[size + 1].select("lang", F.col("gram").bitwiseAND(F.lit(MASKS[size])).alias("gram"))
        levels[size] = written(upper.groupBy("lang", "gram").agg(F.count("*").alias("n")), f"grams{size}")
    total = levels[1].groupBy("lang").agg(F.sum("n").alias("total"))
    # one more for a character that the language never has
    lower = levels[1].join(F.broadcast(total), "lang").select("lang", "gram", "n", (F.col("n") / (F.col("total") + 1)).alias("p"))
    unseen = total.select("lang", F.lit(0).alias("size"), F.lit(0).cast("long").alias("gram"), (-F.log(F.col("total") + 1)).alias("logb"))
    probabilities, backoffs = [lower.withColumn("size", F.lit(1))], [unseen]
    for size in range(2, ORDER + 1):
        at = levels[size].withColumn("context", F.shiftrightunsigned("gram", 16)).join(F.broadcast(_discounts(levels[size])), "lang")
        context = at.groupBy("lang", "context").agg(
            F.sum("n").alias("total"),
            F.sum(F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).alias("taken"),
        )
        context = written(context, f"contexts{size}")
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        joined = (
            at.join(context, ["lang", "context"])
            .withColumn("tail", F.col("gram").bitwiseAND(F.lit(MASKS[size - 1])))
            .join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("p_tail")), ["lang", "tail"])
        )
        p = (F.col("n") - taken) / F.col("total") + F.col("taken") / F.col("total") * F.col("p_tail")
        lower = written(joined.select("lang", "gram", "n", p.alias("p")), f"p{size}")
        probabilities.append(lower.withColumn("size", F.lit(size)))
        backoffs.append(context.select("lang", F.lit(size - 1).alias("size"), F.col("context").alias("gram"), F.log(F.greatest(F.col("taken") / F.col("total"), F.lit(1e-9))).alias("logb")))
    logp, logb = probabilities[0], backoffs[0]
    for x in probabilities[1:]:
        logp = logp.unionByName(x)
    for x in backoffs[1:]:
        logb = logb.unionByName(x)
    return logp.select("lang", "size", "gram", "n", F.log("p").alias("logp")), logb


class HashArrays:
    """Values by 64-bit key in arrays sorted by hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(1, int(len(keys)).bit_length())
        self.shift = U64(64 - self.bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << self.bits) + 1, dtype=U64)).astype(np.int32)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are there."""
        out, there = np.zeros(len(keys), self.values.dtype), np.zeros(len(keys), bool)
        bucket = (keys >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        todo = np.flatnonzero(at < end)
        at, end, left = at[todo], end[todo], keys[todo]
        while len(todo):
            same = self.keys[at] == left
            out[todo[same]] = self.values[at[same]]
            there[todo[same]] = True
            at = at + 1
            on = ~same & (at < end)
            todo, at, end, left = todo[on], at[on], end[on], left[on]
        return out, there


def _key(lang: np.ndarray | int, gram: np.ndarray) -> np.ndarray:
    return mix(mix(gram) ^ (np.asarray(lang).astype(U64) + U64(1)))


class NgramModel:
    """The whole model as tables: logp and logb (lang, size, gram, value)."""

    def __init__(self, langs: list[str], logp: DataFrame, logb: DataFrame):
        self.langs, self.logp, self.logb = {x: i for i, x in enumerate(langs)}, logp, logb

    def scored(self, grams: DataFrame) -> DataFrame:
        """lang, gram, logp: the natural log probability of the last character of each distinct 4-gram after the first three."""
        out = grams.select("lang", "gram", F.lit(0.0).alias("logp"), F.lit(True).alias("open"))
        for size in range(ORDER, 0, -1):
            own = self.logp.filter(F.col("size") == size).select("lang", F.col("gram").alias("part"), F.col("logp").alias("own"))
            weight = self.logb.filter(F.col("size") == size - 1).select("lang", F.col("gram").alias("context"), F.col("logb").alias("weight"))
            part = F.col("gram") if size == ORDER else F.col("gram").bitwiseAND(F.lit(MASKS[size]))
            out = out.withColumn("part", part).withColumn("context", F.shiftrightunsigned("part", 16))
            out = out.join(maybe_broadcast(own, LOW), ["lang", "part"], "left")
            # a language without a model has no weight for an unseen character
            out = out.join(maybe_broadcast(weight, LOW), ["lang", "context"], "left" if size > 1 else "inner")
            step = F.when(F.col("open"), F.coalesce("own", "weight", F.lit(0.0))).otherwise(0.0)
            out = out.select("lang", "gram", (F.col("logp") + step).alias("logp"), (F.col("open") & F.col("own").isNull()).alias("open"))
        return written(out.select("lang", "gram", "logp"), "scores")


def fit(reference: DataFrame) -> NgramModel:
    """Count, estimate and store the model of ``reference`` (lang, text)."""
    counts = written(count_grams(reference), "grams")
    logp, logb = kneser_ney(counts)
    logp, logb = written(logp, "logp"), written(logb, "logb")
    return NgramModel(sorted(r.lang for r in logb.filter("size = 0").select("lang").collect()), logp, logb)


def base_measures(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, offs = text_buffers(column)
    n = len(offs) - 1
    member = SPACED[data]
    starts, ends, doc = runs(member, offs)
    n_words = np.bincount(doc, minlength=n)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags)])
        return c[offs[1:]] - c[offs[:-1]]

    chars = per_doc(member & ((data & 0xC0) != 0x80))
    symbols = per_doc(SYMBOLS[data])
    # lines with a word, compared as they stand
    ls, le, ld = runs(data != 0x0A, offs)
    c = np.concatenate([[0], np.cumsum(member)])
    real = c[le] > c[ls]
    ls, le, ld = ls[real], le[real], ld[real]
    line = span_hash(data, ls, le) ^ mix(ld.astype(U64))
    lines = np.bincount(ld, minlength=n)
    _, first = np.unique(line, return_index=True)
    dup_lines = lines - np.bincount(ld[first], minlength=n)
    h, at = window_hash(span_hash(data, starts, ends), doc, 3)
    h = h ^ mix(doc[at].astype(U64) + U64(1 << 40))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    word = np.zeros(len(doc) + 2, bool)
    for k in range(3):
        word[at[twice] + k] = True
    repeated = np.bincount(doc[word[: len(doc)]], minlength=n)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated}


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _held(scores: DataFrame, langs: dict[str, int]) -> HashArrays:
    """The probabilities in arrays; ``langs`` names each language's code."""
    names = F.array(*map(F.lit, langs)) if langs else F.array(F.lit(""))
    rows = scores.select((F.array_position(names, F.col("lang")) - 1).cast("int").alias("code"), "gram", "logp").toArrow()
    code, gram, values = (rows.column(c).to_numpy() for c in ("code", "gram", "logp"))
    return HashArrays(_key(code, gram.astype(np.int64).view(U64)), values)


def _joined(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """k1, k2, log_perplexity of the distinct rows of ``docs`` (k1, k2, lang, text)."""

    @memo.task()
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                k1, k2 = (part.column(c).to_numpy() for c in ("k1", "k2"))
                for lang, at in by_language(part):
                    keys, doc = grams(*characters(part.column("text").take(pa.array(at))))
                    order = np.lexsort((keys, doc))
                    keys, doc = keys[order], doc[order]
                    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])[: len(keys)])
                    n, row = np.diff(np.append(first, len(keys))), at[doc[first]]
                    yield pa.record_batch({"k1": pa.array(k1[row]), "k2": pa.array(k2[row]), "lang": pa.array([lang] * len(row), pa.string()), "gram": pa.array(keys[first].view(np.int64)), "n": pa.array(n, pa.int64())})

    counted = docs.select("k1", "k2", "lang", "text").mapInArrow(count, "k1 long, k2 long, lang string, gram long, n long")
    # equal rows add to both sums alike
    return counted.join(scores, ["lang", "gram"]).groupBy("k1", "k2").agg((-F.sum(F.col("n") * F.col("logp")) / F.sum("n")).alias("log_perplexity"))


def measure(docs: DataFrame, model: NgramModel, held: int = HELD) -> DataFrame:
    """doc_id, lang, the base measures, and log_perplexity (null without a model or 4-grams)."""
    scores = model.scored(count_grams(docs).select("lang", "gram"))
    join = not at_most(scores, held)
    shared = docs.sparkSession.sparkContext.broadcast(None if join else (model.langs, _held(scores, model.langs)))

    @memo.task()
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, values = shared.value or ({}, None)
        for batch in batches:
            for part in slices(batch):
                base = base_measures(part.column("text"))
                log_ppl = np.full(part.num_rows, np.nan)
                for lang, at in by_language(part):
                    if lang not in langs:
                        continue
                    keys, doc = grams(*characters(part.column("text").take(pa.array(at))))
                    n = np.bincount(doc, minlength=len(at))
                    s = np.bincount(doc, weights=values.get(_key(langs[lang], keys))[0], minlength=len(at))
                    log_ppl[at] = np.where(n > 0, -s / np.maximum(n, 1), np.nan)
                ids = {c: part.column(c) for c in ("k1", "k2", "doc_id") if c in part.schema.names}
                yield pa.record_batch(ids | {"lang": pc.fill_null(part.column("lang"), NO_LANG)} | {k: pa.array(base[k].astype(np.int64)) for k in MEASURES} | {"log_perplexity": pa.array(log_ppl, mask=np.isnan(log_ppl))})

    columns = "doc_id long, lang string, " + ", ".join(f"{k} long" for k in MEASURES) + ", log_perplexity double"
    docs = docs.select("doc_id", "lang", "text")
    if not join:
        return docs.mapInArrow(score, columns)
    named = docs.withColumn("k1", F.xxhash64("doc_id", "lang", "text")).withColumn("k2", F.xxhash64(F.lit(1), "doc_id", F.lit(2), "lang", F.lit(3), "text"))
    plain = named.mapInArrow(score, "k1 long, k2 long, " + columns).drop("log_perplexity")
    return plain.join(_joined(named, scores), ["k1", "k2"], "left").drop("k1", "k2")


def judge(scored: DataFrame, band: float = BAND) -> DataFrame:
    """Add base_failed and kept: bands per language over all documents that pass the base rules."""
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("base_failed", base_failed)
    quantiles = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000)
    bands = (
        scored.filter("not base_failed and log_perplexity is not null")
        .groupBy("lang")
        .agg(quantiles.alias("q"))
        .select("lang", F.expr(f"q[1] - {band} * greatest(q[2] - q[0], {NARROWEST})").alias("lower_band"), F.expr(f"q[1] + {band} * greatest(q[2] - q[0], {NARROWEST})").alias("upper_band"))
    )
    inside = F.col("log_perplexity").between(F.col("lower_band"), F.col("upper_band"))
    return scored.join(maybe_broadcast(bands, 10_000), "lang", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def reference_of(docs: DataFrame, good: DataFrame) -> DataFrame:
    """The documents named in ``good`` (doc_id); of a language in which none of these has a 4-gram, all."""
    docs = docs.withColumn("lang", F.coalesce("lang", F.lit(NO_LANG)))
    best = docs.join(maybe_broadcast(good, 4_000_000), "doc_id", "left_semi")
    served = best.filter(F.length("text") >= ORDER).select("lang").distinct()
    return best.unionByName(docs.join(maybe_broadcast(served, 10_000), "lang", "left_anti").select(*best.columns))


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    model = fit(reference_of(docs, good))
    return judge(written(measure(docs, model), "scored")).select("doc_id", *MEASURES, "base_failed", "kept", "log_perplexity", "lower_band", "upper_band")
