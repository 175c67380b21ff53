"""Statistics and the registry of predicates, kept up to date from what changed.

Each version of a ledger table changes counts: added rows add to them, deleted rows take
away. ``refresh`` works out the changes of the versions that it hasn't seen and appends
them, with the versions that they come from, in one commit: a refresh that dies changes
nothing, one that comes again finds nothing to do, and of two at once one fails with
``Conflict``. Only new versions' files are read, besides ids to find a row's session; a
delete reads the rows that it removed. A replaced or compacted table is counted whole,
before and after.

Documents are counted as ``documents``, claims as ``verified`` or ``unverified``,
relationships by their type in the session of their source. A row whose document is
unknown counts in no session. A relationship is taken to have both its claims in the
ledger, in one session, when it is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.operators.store import Ledger, first_seen

COUNTED = ("documents", "claims", "relationships")


def _marked(ledger: Ledger, name: str, rows: DataFrame) -> DataFrame:
    """session_id, measure, key of each row of a table. Rows that were deleted meanwhile still give their session."""
    if name == "documents":
        return rows.select("session_id", F.lit("documents").alias("measure"), F.lit("").alias("key"))
    of = ledger.history("documents").select(F.col("id").alias("document_id"), "session_id").distinct()
    if name == "claims":
        return rows.join(of, "document_id").select("session_id", F.when(F.col("verified"), "verified").otherwise("unverified").alias("measure"), F.lit("").alias("key"))
    claims = ledger.history("claims").select(F.col("id").alias("source_claim_id"), "document_id").distinct()
    return rows.join(claims, "source_claim_id").join(of, "document_id").select("session_id", F.lit("relationships").alias("measure"), F.col("relationship_type").alias("key"))


def _counted(marked: DataFrame, sign: int) -> DataFrame:
    return marked.groupBy("session_id", "measure", "key").agg((sign * F.count("*")).alias("n"))


def refresh(ledger: Ledger) -> bool:
    """Bring the statistics and the registry up to the newest versions; whether anything was new."""
    at = ledger.version("statistics")
    seen = {r.source: r.version for r in ledger.read("statistics", at).groupBy("source").agg(F.max("version").alias("version")).collect()}
    found, fresh = [], []
    for name in COUNTED:
        for n, kind in ledger.changes(name, seen.get(name, 0)):
            if kind == "a":
                parts = [(ledger.added(name, n, kind), 1)]
            elif kind:
                parts = [(ledger.removed(name, n, kind), -1)]
            else:
                parts = [(ledger.read(name, n), 1), (ledger.read(name, n - 1), -1)]
            if name == "claims" and parts[0][1] > 0:
                fresh.append(parts[0][0])
            # a row without a count says that the version was seen
            none = ledger.spark.createDataFrame([(None, "", "", 0)], "session_id string, measure string, key string, n long")
            for rows, sign in parts:
                none = none.unionByName(_counted(_marked(ledger, name, rows), sign))
            found.append(none.withColumns({"source": F.lit(name), "version": F.lit(n)}))
    if not found:
        return False
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    if fresh:
        # before the commit: predicates that are there already are left alone, so this may come again
        new = fresh[0]
        for x in fresh[1:]:
            new = new.unionByName(x)
        ledger.append("predicate_registry", first_seen(new).join(ledger.read("predicate_registry").select("predicate"), "predicate", "left_anti"))
    ledger.append("statistics", every.groupBy("session_id", "measure", "key", "source", "version").agg(F.sum("n").alias("n")), expected=at)
    return True


def session_stats(ledger: Ledger) -> DataFrame:
    """The record of ``ledger.session_stats`` from the changes alone: no document, claim or relationship is read."""
    now = ledger.read("statistics").filter("session_id is not null").groupBy("session_id", "measure", "key").agg(F.sum("n").alias("n")).filter("n <> 0")
    total = lambda m: F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("n"))), F.lit(0))
    typed = F.array_sort(F.collect_list(F.when(F.col("measure") == "relationships", F.struct(F.col("key").alias("relationship_type"), "n"))))
    of = now.groupBy("session_id").agg(total("documents").alias("documents"), total("verified").alias("verified_claims"), total("unverified").alias("unverified_claims"), total("relationships").alias("relationships"), typed.alias("_typed"))
    by_type = F.when(F.size("_typed") > 0, F.map_from_entries("_typed"))
    out = ledger.read("sessions").select(F.col("id").alias("session_id")).join(of.withColumn("relationships_by_type", by_type).drop("_typed"), "session_id", "left")
    return out.fillna(0, ["documents", "verified_claims", "unverified_claims", "relationships"])
