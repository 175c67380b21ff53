"""A corpus pipeline of five stages over ``documents``.

Toxic documents go; of each component of near duplicates the document with the
least doc_id stays (of several rows with it, the one with the least text hash);
documents with a benchmark passage go; personal data gets surrogates; the rest is
packed into token sequences. Each stage works on all that the one before it kept.
All but the last return the columns of ``documents``, whatever their names; columns
besides doc_id and text pass by.

Null and empty texts are clean: they are not toxic, link with nothing, hold no
passage and no personal data, and are packed as one end id. Repeated rows are one
component, of which one row stays; in the other stages each row counts for itself.
Empty tables stay empty; without labels or benchmark items nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import decontam, jaccard, packing, pii, toxicity
from proofmill.llm.shared import made, maybe_broadcast, table, tidied, written

CHUNKS = 100_000  # chunks in a generation of the packing encoder's table


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns in one struct, so that no name clashes with what an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*rest).alias("_rest")] if rest else []))


def _wide(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return found.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in docs.columns))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose score reaches the threshold; null and empty texts stay, repeated rows go or stay alike."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _wide(toxicity.score(_narrow(docs), model).filter(F.col("tox.score") < toxicity.THRESHOLD), docs)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component; documents without words link with nothing and stay."""
    # rows are told apart by a number that is written down with them: a doc_id may recur
    rows = written(_narrow(docs).withColumn("_row", F.monotonically_increasing_id()).withColumn("_hash", F.xxhash64("text")), "rows")
    found = written(jaccard.near_rows(rows, ("_row", "_hash")).filter("root is not null").select("root", "doc_id", "_hash", "_row"), "near")
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "_hash", "_row")).alias("one")).select("one._row")
    dropped = written(found.select("_row").join(kept, "_row", "left_anti"), "dropped", found)
    return _wide(rows.join(maybe_broadcast(dropped, jaccard.IDS), "_row", "left_anti"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of a benchmark item occurs; null and empty texts stay, repeated rows go or stay alike."""
    return _wide(decontam.find_leaks(_narrow(docs), table(spark, sf_dir, "benchmark")).filter(F.size("leak.hit") == 0), docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; n_chars follows the new text. Null texts stay null, repeated rows get equal texts."""
    out = pii.replace_pii(_narrow(docs))
    wide = _wide(out, docs)
    if "n_chars" not in docs.columns:
        return wide
    kind = docs.schema["n_chars"].dataType
    count = F.when(F.size("pii") > 0, F.length("text").cast(kind)).otherwise(F.col("_rest")["n_chars"])
    return out.select(*(count.alias(c) if c == "n_chars" else F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in docs.columns))


def vector_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their sequences and offsets; null and empty texts are one end id, repeated rows are packed each."""
    import public_tokenizers

    # the earlier stages have filled the executors' heaps by now, so the encoder's table is a small one
    return packing.pack(packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2, packing.MAX_TOKENS, CHUNKS))


STAGES = [
    ("toxicity", toxicity_filter),
    ("jaccard_join", jaccard_dedup),
    ("decontamination", decontamination),
    ("pii", pii_surrogates),
    ("packing", vector_packing),
]

#: The model of the first stage and the ids of the last have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the working tables of the others are deleted as soon as they have been read."""
    docs, since = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        docs = tidied(written(stage(spark, docs, sf_dir), name), since)
    return docs
