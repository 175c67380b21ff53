"""Answers of an external adjudicator or extractor, parsed row by row without losing a batch to one bad item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.operators.verdict import OFFLINE

VERDICT = "relationship_type string, reason_code string, explanation string, confidence double"
RETRIES, FIRST_WAIT = 4, 5.0
#: What a message about a limit contains.
LIMITS = ("429", "resource_exhausted", "rate limit", "quota exceeded")


#: What is said of a pair whose own verdict is no object, and of a verdict without explanation.
NO_VERDICT, NO_EXPLANATION = "No valid verdict was returned for this claim pair.", "No explanation was returned."


def _fallback(explanation: str | None = None) -> Column:
    said = OFFLINE if explanation is None else OFFLINE | {"explanation": explanation}
    return F.struct(*(F.lit(v).alias(k) for k, v in said.items()))


def parse_verdicts(batches: DataFrame, keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """A row per expected pair of each batch (keys, pair_ids, response): keys, pair_id and verdict.

    An answer whose keys aren't exactly the expected ones, or that is no object, leaves the whole batch
    UNCERTAIN; a value that is no object leaves its own pair so. A batch without an answer counts as failed.
    """
    answers = F.from_json("response", "map<string,string>")
    whole = answers.isNotNull() & (F.array_sort(F.map_keys(answers)) == F.array_sort("pair_ids"))
    each = batches.withColumn("answers", F.when(whole, answers)).select(*keys, "answers", F.explode("pair_ids").alias("pair_id"))
    raw = F.element_at("answers", F.col("pair_id"))
    one = F.when(F.ltrim(raw).startswith("{"), F.from_json(raw, VERDICT))
    given = F.struct(
        F.coalesce(one["relationship_type"], F.lit("UNCERTAIN")).alias("relationship_type"),
        F.coalesce(one["reason_code"], F.lit("INSUFFICIENT_CONTEXT")).alias("reason_code"),
        F.coalesce(one["explanation"], F.lit(NO_EXPLANATION)).alias("explanation"),
        F.coalesce(one["confidence"], F.lit(0.0)).alias("confidence"),
        F.lit("llm").alias("decided_by"),
    )
    verdict = F.when(F.col("answers").isNull(), _fallback()).when(one.isNotNull(), given).otherwise(_fallback(NO_VERDICT))
    return each.select(*keys, "pair_id", verdict.alias("verdict"))


#: Claim fields that must be texts, that may be, and numbers.
REQUIRED = ("block_id", "subject", "predicate", "evidence_quote")
OPTIONAL = ("value_type", "unit", "period_start", "period_end", "period_type", "scope", "basis", "definition", "claim_type")


def parse_claims(responses: DataFrame) -> DataFrame:
    """Claims of JSON arrays in ``response``, with ``item``, their place in the array.

    A response that is no array gives none. An item is skipped, and only it, if a required field is missing, a text
    isn't a text, or a number neither a number nor a text that is one; only ``value`` and the optional texts may be null.
    """
    field = lambda f: F.variant_get("_item", f"$.{f}", "variant")
    kind = lambda f: F.coalesce(F.schema_of_variant(field(f)), F.lit("MISSING"))
    number = lambda f: F.try_variant_get("_item", f"$.{f}", "double")
    whole = lambda f: F.rlike(kind(f), F.lit("^(STRING|BOOLEAN|BIGINT|DECIMAL|DOUBLE|FLOAT)")) & number(f).isNotNull()
    good = F.lit(True)
    for f in REQUIRED:
        good = good & (kind(f) == "STRING")
    for f in OPTIONAL:
        good = good & kind(f).isin("STRING", "VOID", "MISSING")
    good = good & (kind("value").isin("VOID", "MISSING") | whole("value")) & ((kind("confidence") == "MISSING") | whole("confidence"))
    texts = F.from_json("response", "array<string>")
    items = responses.select("*", F.posexplode(texts).alias("item", "_text")).withColumn("_item", F.try_parse_json("_text"))
    real = items.filter(good)
    fields = {f: F.try_variant_get("_item", f"$.{f}", "string") for f in REQUIRED + OPTIONAL} | {"value": number("value"), "confidence": F.coalesce(number("confidence"), F.lit(0.5))}
    return real.select(*responses.columns, "item", *(v.alias(f) for f, v in fields.items()))


def is_limit(message: str) -> bool:
    return any(x in message.lower() for x in LIMITS)


def retry_wait(attempt: int) -> float:
    return FIRST_WAIT * 2**attempt
