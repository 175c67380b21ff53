"""Micro-batches of claims into the ledger."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofmill.operators.store import Conflict, Ledger
from proofmill.plans.link import link_sessions

BUCKETS, NOWHERE = 64, -1


def bucket_of(session: Column) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")


def ingest_batch(ledger: Ledger, documents: DataFrame):
    """A foreachBatch body: claims not yet stored are added, then the sessions that they touch are linked once.

    Claims and relationships lie in buckets of their session, and only the buckets of the batch's sessions are read.
    A batch that comes again adds nothing: claims are keyed by id and relationships by their undirected pair.
    """
    of = documents.select(F.col("id").alias("document_id"), "session_id")

    def run(batch: DataFrame, _epoch: int) -> None:
        # a batch that failed after its claims were stored comes again: its sessions are those of all its claims
        touched = batch.select("document_id").join(of, "document_id").select("session_id").distinct()
        buckets = {r.b for r in touched.select(bucket_of(F.col("session_id")).alias("b")).distinct().collect()}
        # a claim of an unknown document has no session: it is stored, in a bucket of its own, and linked with nothing
        buckets.add(NOWHERE)
        placed = batch.dropDuplicates(["id"]).join(of, "document_id", "left").withColumn("_bucket", F.coalesce(bucket_of(F.col("session_id")), F.lit(NOWHERE)))
        placed = placed.withColumn("_bucket", F.when(F.col("session_id").isNull(), NOWHERE).otherwise(F.col("_bucket")))
        ledger.append("claims", placed.join(ledger.read("claims", buckets=buckets).select("id"), "id", "left_anti"), "_bucket")
        claims = ledger.read("claims", buckets=buckets).join(of, "document_id").join(touched, "session_id", "left_semi")
        stored = ledger.read("relationships", buckets=buckets).join(claims.select(F.col("id").alias("source_claim_id")), "source_claim_id", "left_semi")
        ledger.append("relationships", link_sessions(claims, stored).withColumn("_bucket", bucket_of(F.col("session_id"))), "_bucket")
        for name in ("claims", "relationships"):
            with contextlib.suppress(Conflict):  # another writer is at it; a later batch compacts
                ledger.compact(name)

    return run


def start(stream: DataFrame, ledger: Ledger, documents: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(ingest_batch(ledger, documents)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
