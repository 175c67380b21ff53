"""Linking a session's claims: pairs, candidates, rules, adjudication, storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.operators import batching
from proofmill.operators import candidates as C
from proofmill.operators import pairs as P
from proofmill.operators import verdict as V
from proofmill.operators.adjudicate import parse_verdicts

#: Takes open pairs (session_id, ord_a, ord_b, id_a, id_b) and the claims with ``ord``; returns the pairs with ``verdict``.
Adjudicator = Callable[[DataFrame, DataFrame], DataFrame]


def stored_pairs(kinds: DataFrame, relationships: DataFrame) -> DataFrame:
    """session_id, ord_a, ord_b, block_a, block_b: the pairs of kinds' members that have a stored relationship in either direction."""
    lo, hi = P.undirected(F.col("source_claim_id"), F.col("target_claim_id"))
    stored = relationships.select(lo.alias("lo"), hi.alias("hi")).distinct()
    claims = kinds.select("session_id", "block", F.inline("members").alias("ord", "id", "doc"))
    side = lambda s: claims.select("session_id", F.struct("ord", "block").alias(f"at_{s}"), F.col("id").alias(s))
    both = stored.join(side("lo"), "lo").join(side("hi"), ["session_id", "hi"]).withColumns({"a": F.least("at_lo", "at_hi"), "b": F.greatest("at_lo", "at_hi")})
    return both.select("session_id", *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("ord", "block") for s in "ab")).distinct()


def answered_candidates(claims: DataFrame, relationships: DataFrame) -> DataFrame:
    """The candidates of claims with ``ord`` that aren't stored in either direction, for ``expanded``; verdict is null where the rules leave them open."""
    kinds = C.kinds(claims, V.compared, "rule")
    told = ["session_id", *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("ord", "block") for s in "ab")]
    ruled = V.ruled_kinds(kinds).select(*told, "verdict", F.lit(False).alias("stored"))
    stored = stored_pairs(kinds, relationships).withColumn("stored", F.lit(True))
    return C.linked(kinds, ruled.unionByName(stored, allowMissingColumns=True))


def with_claims(found: DataFrame, claims: DataFrame) -> DataFrame:
    """Pairs by ``ord_a`` and ``ord_b`` with both claims, and what the rules compare, as structs a and b."""
    whole = V.prepared(claims)
    side = lambda s: whole.select("session_id", F.col("ord").alias(f"ord_{s}"), F.struct(*whole.columns).alias(s))
    return found.join(side("a"), ["session_id", "ord_a"]).join(side("b"), ["session_id", "ord_b"])


def recorded(responses: DataFrame) -> Adjudicator:
    """An adjudicator whose answers were written down: ``responses`` has session_id, batch_id and the response to a batch of open pairs.

    Pairs find their verdict by their batch and number; batches without a usable response are UNCERTAIN.
    """

    def adjudicate(open_: DataFrame, claims: DataFrame) -> DataFrame:
        keys = ["session_id", "batch_id"]
        batched = batching.pair_batches(open_, claims)
        # a batch holds a few pairs, so they travel with it and need no join afterwards
        asked = batched.groupBy(*keys).agg(F.collect_list(F.struct("pair_id", "ord_a", "ord_b", "id_a", "id_b")).alias("pairs")).withColumn("pair_ids", F.col("pairs.pair_id"))
        told = asked.join(responses.select(*keys, "response"), keys, "left")
        verdicts = parse_verdicts(told, (*keys, "pairs"))
        own = F.filter("pairs", lambda p: p["pair_id"] == F.col("pair_id"))[0]
        return verdicts.withColumn("own", own).select("session_id", "pair_id", "batch_id", "own.ord_a", "own.ord_b", "own.id_a", "own.id_b", "verdict")

    return adjudicate


def link_sessions(claims: DataFrame, relationships: DataFrame, adjudicate: Adjudicator = V.offline, now=None, distinct_ids: bool = False) -> DataFrame:
    """New relationships of the verified claims of every session.

    Pairs already stored, in either direction, are dropped. Stored pairs and what the rules say of kinds of claims are
    found on their own and go, as pairs of numbers, to the task that finds the candidates of their blocks; what the rules
    leave open goes to the adjudicator. Where no id occurs in two claims (``distinct_ids``), no pair can occur twice; otherwise one row of each is kept.
    """
    verified = P.ordered(claims.filter("verified"))
    found = answered_candidates(verified, relationships)
    if adjudicate is V.offline:
        # a constant answer needs no claims, so it is given before kinds are made pairs
        answered = C.expanded(found.withColumn("verdict", F.coalesce("verdict", V.uncertain())))
    else:
        closed, open_ = map(C.expanded, V.partition(found))
        answered = closed.unionByName(adjudicate(open_.drop("verdict"), verified).select(closed.columns))
    results = answered.withColumnsRenamed({"id_a": "source_claim_id", "id_b": "target_claim_id"}).filter("source_claim_id is not null and target_claim_id is not null")
    if not distinct_ids:
        results = P.dedup_undirected(results, [F.when(F.col("verdict.decided_by") == "rules", 0).otherwise(1), "ord_a", "ord_b"])
    kept = results.withColumn("verdict", F.coalesce("verdict", V.uncertain())).select("session_id", "source_claim_id", "target_claim_id", "verdict.*")
    rid = F.sha2(F.concat_ws("|", "source_claim_id", "target_claim_id"), 256)
    return kept.withColumn("id", rid).withColumn("created_at", F.current_timestamp() if now is None else now)
