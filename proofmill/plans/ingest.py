"""Documents into the ledger: layout and tables to blocks, extracted claims to verified ones, statuses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.functions.text import ustrip
from proofmill.llm.shared import at_most, written
from proofmill.operators import batching, verify
from proofmill.operators import verdict as V
from proofmill.operators.adjudicate import parse_claims
from proofmill.operators.store import first_seen
from proofmill.plans.link import Adjudicator, link_sessions

#: Takes blocks with their ``batch_id``; returns the answers: document_id, batch_id, response.
Extractor = Callable[[DataFrame], DataFrame]
#: Statuses of a document as it is processed.
PARSED, EXTRACTED, FAILED = "parsed", "extracted", "failed"
#: Fixed value: the confidence of a claim that states none.
CONFIDENCE = 0.5


def page_texts(layout: DataFrame) -> DataFrame:
    """document_id, page, text: the raw lines of each page, top to bottom."""
    lines = F.array_sort(F.collect_list(F.struct("y0", "x0", "text")))
    return layout.groupBy("document_id", "page").agg(lines.alias("lines")).select("document_id", "page", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))


def page_raw_text(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (document_id, page) with the page's text, empty where there is no such page."""
    return wanted.join(pages, ["document_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def render_tables(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (document_id, page, k, rows, error) as text of 40 characters or more, and the pages whose tables couldn't be read."""
    good = tables.filter("error is null").select("document_id", "page", "k", batching.render_table(F.col("rows")).alias("text"))
    bad = tables.filter("error is not null").groupBy("document_id", "page").agg(F.min("error").alias("error"))
    return good.filter(F.length(ustrip(F.col("text"))) >= batching.LEAST_CHARS), bad


def evidence_blocks(layout: DataFrame, tables: DataFrame) -> DataFrame:
    """id, document_id, page, block_type, seq, text: a document's merged text blocks, then its tables; seq counts in a page and type."""
    text = batching.merge_blocks(layout).select("document_id", "page", F.lit("TEXT").alias("block_type"), "seq", "text")
    rendered = render_tables(tables)[0].select("document_id", "page", F.lit("TABLE").alias("block_type"), F.col("k").cast("long").alias("seq"), "text")
    return text.unionByName(rendered).withColumn("id", F.concat_ws("-", "document_id", "block_type", "page", "seq"))


def process_claims(raw_claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Claims with their block's page and whether the quote was found in it; those that name an unknown block are dropped."""
    found, _ = verify.attach_blocks(raw_claims, blocks)
    checked = verify.verify(found.withColumn("evidence_quote", ustrip(F.coalesce("evidence_quote", F.lit("")))))
    renamed = {"evidence_block_id": "block_id", "source_page": "page", "source_text": "evidence_quote"}
    kept = [c for c in raw_claims.columns if c not in ("block_id", "evidence_quote", "confidence")]
    return checked.select(*kept, *(F.col(old).alias(new) for new, old in renamed.items()), "verified", F.coalesce("confidence", F.lit(CONFIDENCE)).alias("confidence"))


def one_session(jobs: DataFrame) -> str | None:
    """The session of a batch (document_id, session_id); None for an empty one."""
    found = [r.session_id for r in jobs.select("session_id").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError("the documents of a batch must belong to one session")
    return found[0] if found else None


def extracted_claims(blocks: DataFrame, responses: DataFrame | Extractor) -> DataFrame:
    """Claims of an extractor's answers: batch by batch, written down in ``responses`` (document_id, batch_id, response) or given by it.

    A batch without a usable answer gives no claims, an unusable item costs only itself, and a claim that names no block
    of its document is dropped. A claim's id is its document, batch and place in the answer.
    """
    batched = batching.block_batches(blocks.withColumn("_table", (F.col("block_type") != "TEXT").cast("int")), ["_table", "page", "seq"])
    responses = responses(batched) if callable(responses) else responses
    asked = batched.select("document_id", "batch_id").distinct()
    raw = parse_claims(asked.join(responses.select("document_id", "batch_id", "response"), ["document_id", "batch_id"])).drop("response")
    named = raw.withColumn("id", F.concat_ws("-", "document_id", "batch_id", "item")).drop("batch_id", "item")
    return process_claims(named, blocks)


def ingest_batch(jobs: DataFrame, layout: DataFrame, tables: DataFrame, responses: DataFrame | Extractor, stored: dict[str, DataFrame], adjudicate: Adjudicator = V.offline, now=None) -> dict[str, DataFrame]:
    """New rows of every ledger table from one upload: documents read, claims extracted and verified, then one linking pass.

    ``jobs`` has document_id, session_id, filename and ``error``, null for a document that could be read. Errors are rows: a
    document with one is ``failed``, gives no blocks and no claims, and neither stops nor hides the others. All documents
    must be of one session, whose ``stored`` claims and relationships take part in linking. ``now`` is the claims' time.
    Blocks and claims are read by several later steps, so each is made once, as a working table in the shared folder.
    """
    session = one_session(jobs)
    at = F.current_timestamp() if now is None else now
    readable = jobs.filter("error is null").select("document_id")
    status = F.when(F.col("error").isNotNull(), FAILED).otherwise(EXTRACTED)
    documents = jobs.select(F.col("document_id").alias("id"), "session_id", "filename", status.alias("status"), "error")
    kept = lambda df: df.join(readable, "document_id", "left_semi")
    blocks = written(evidence_blocks(kept(layout), kept(tables)), "blocks")
    claims = written(extracted_claims(blocks, responses).withColumn("created_at", at), "claims")
    known = stored["documents"].filter(F.col("session_id") == session).select(F.col("id").alias("document_id"))
    before = stored["claims"].join(known, "document_id", "left_semi")
    every = before.unionByName(claims, allowMissingColumns=True).withColumn("session_id", F.lit(session))
    related = stored["relationships"].join(before.select(F.col("id").alias("source_claim_id")), "source_claim_id", "left_semi")
    registry = first_seen(claims).join(stored["predicate_registry"].select("predicate"), "predicate", "left_anti")
    repeated = every.filter("verified").groupBy("id").count().filter("count > 1")
    links = link_sessions(every, related, adjudicate, at, distinct_ids=at_most(repeated, 0))
    return {"documents": documents, "evidence_blocks": blocks, "claims": claims, "relationships": links, "predicate_registry": registry}


def processed(documents: DataFrame, blocks: DataFrame, failed: DataFrame) -> DataFrame:
    """Documents with their new status: failed ones (id) stay in the table, those with blocks are extracted, others as they were."""
    bad = failed.select("id", F.lit(True).alias("_bad")).distinct()
    done = blocks.select(F.col("document_id").alias("id"), F.lit(True).alias("_done")).distinct()
    status = F.when(F.col("_bad"), FAILED).when(F.col("_done"), EXTRACTED).otherwise(F.col("status"))
    return documents.join(bad, "id", "left").join(done, "id", "left").withColumn("status", status).drop("_bad", "_done")


def batch_counters(documents: DataFrame) -> DataFrame:
    """Per session: documents, how many succeeded and how many failed."""
    return documents.groupBy("session_id").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == EXTRACTED).alias("succeeded"), F.count_if(F.col("status") == FAILED).alias("failed"))


def link_counters(decided: DataFrame, fresh: DataFrame) -> DataFrame:
    """Per session: pairs, those already stored, those that the rules decide, those for the adjudicator. ``fresh``: decided pairs that aren't stored."""
    of = decided.groupBy("session_id").agg(F.count("*").alias("pairs"))
    new = fresh.groupBy("session_id").agg(F.count("*").alias("fresh"), F.count("verdict").alias("ruled"))
    out = of.join(new, "session_id", "left").fillna(0, ["fresh", "ruled"])
    return out.select("session_id", "pairs", (F.col("pairs") - F.col("fresh")).alias("skipped"), "ruled", (F.col("fresh") - F.col("ruled")).alias("open"))


def batch_totals(batched: DataFrame, key: str) -> DataFrame:
    """Per request batch: items, least and most tokens of one, tokens in all."""
    return batched.groupBy(key, "batch_id").agg(F.count("*").alias("items"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.sum("tokens").alias("tokens"))
