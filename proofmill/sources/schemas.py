"""Schemas of the ledger's tables."""

from pyspark.sql import types as T

KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def schema(text: str) -> T.StructType:
    """A schema from "name kind" pairs; it needs no session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (field.split() for field in text.split(","))])


SESSIONS = schema("id string, created_at timestamp, status string")
DOCUMENTS = schema("id string, session_id string, filename string, uploaded_at timestamp, page_count int, status string")
EVIDENCE_BLOCKS = schema("id string, document_id string, page int, block_type string, text string")
CLAIMS = schema(
    "id string, document_id string, evidence_block_id string, subject string, predicate string, value double, value_type string, unit string, "
    "period_start string, period_end string, period_type string, scope string, basis string, definition string, claim_type string, "
    "source_page int, source_text string, verified boolean, confidence double, created_at timestamp"
)
RELATIONSHIPS = schema(
    "id string, source_claim_id string, target_claim_id string, relationship_type string, reason_code string, explanation string, confidence double, decided_by string, created_at timestamp"
)
PREDICATE_REGISTRY = schema("predicate string, first_seen_document_id string, example_definition string")
#: Changes of counts: how a version of a table changed what is counted under a key of a session.
STATISTICS = schema("session_id string, measure string, key string, n long, source string, version int")
RAW_CLAIMS = schema(
    "block_id string, subject string, predicate string, value double, value_type string, unit string, period_start string, period_end string, period_type string, "
    "scope string, basis string, definition string, claim_type string, evidence_quote string, confidence double"
)
TABLES = {
    "sessions": SESSIONS,
    "documents": DOCUMENTS,
    "evidence_blocks": EVIDENCE_BLOCKS,
    "claims": CLAIMS,
    "relationships": RELATIONSHIPS,
    "predicate_registry": PREDICATE_REGISTRY,
    "statistics": STATISTICS,
}
