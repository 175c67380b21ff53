"""Read queries of the ledger: lists, detail, statistics, search and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.functions.text import filled, ustrip


def point(df: DataFrame, id_: str) -> DataFrame:
    return df.filter(F.col("id") == id_).limit(1)


def where_given(df: DataFrame, **values) -> DataFrame:
    """Equality filters for the arguments that are given; an empty one counts as absent."""
    for name, value in values.items():
        if value:
            df = df.filter(F.col(name) == value)
    return df


def newest_first(df: DataFrame, at: str = "created_at") -> DataFrame:
    return df.orderBy(F.desc(at), "id")


def list_claims(claims: DataFrame, documents: DataFrame, session_id: str | None = None, document_id: str | None = None, verified_only: bool = False) -> DataFrame:
    """Claims with their document's name."""
    named = documents.select(F.col("id").alias("document_id"), F.col("session_id").alias("document_session"), F.col("filename").alias("document_name"))
    out = claims.join(named, "document_id")
    out = where_given(out, document_session=session_id, document_id=document_id)
    return (out.filter("verified") if verified_only else out).drop("document_session")


def list_relationships(relationships: DataFrame, claims: DataFrame, documents: DataFrame, session_id: str | None = None, relationship_type: str | None = None) -> DataFrame:
    """Relationships whose two claims lie in one session, with both claims nested."""
    held = claims.select("id", "document_id", "source_text", "source_page", "verified").join(documents.select(F.col("id").alias("document_id"), "session_id", F.col("filename").alias("document_name")), "document_id")
    side = lambda s: held.select(F.col("id").alias(f"{s}_id"), F.col("session_id").alias(f"{s}_session"), F.struct("id", "document_id", "source_text", "source_page", "verified", "document_name").alias(s))
    out = (
        relationships.drop("session_id")
        .join(side("claim_a"), F.col("source_claim_id") == F.col("claim_a_id"))
        .join(side("claim_b"), F.col("target_claim_id") == F.col("claim_b_id"))
        .filter("claim_a_session = claim_b_session")
        .withColumnRenamed("claim_a_session", "session_id")
        .drop("claim_a_id", "claim_b_id", "claim_b_session")
    )
    return where_given(out, session_id=session_id, relationship_type=relationship_type)


def relationship_detail(relationships: DataFrame, claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Each relationship with five nested objects: itself, both claims, both documents."""
    side = lambda s: claims.select(F.struct("*").alias(f"claim_{s}")).join(documents.select(F.struct("*").alias(f"document_{s}")), F.expr(f"claim_{s}.document_id = document_{s}.id"))
    whole = relationships.select(F.struct("*").alias("relationship"))
    return whole.join(side("a"), F.expr("relationship.source_claim_id = claim_a.id")).join(side("b"), F.expr("relationship.target_claim_id = claim_b.id")).filter("document_a.session_id = document_b.session_id")


def session_stats(sessions: DataFrame, documents: DataFrame, claims: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row a session, zeros kept: documents, verified and unverified claims, relationships, and their counts by type."""
    d = documents.groupBy("session_id").agg(F.count("*").alias("documents"))
    c = claims.join(documents.select(F.col("id").alias("document_id"), F.col("session_id").alias("s")), "document_id").groupBy(F.col("s").alias("session_id")).agg(F.count_if("verified").alias("verified_claims"), F.count_if(~F.col("verified")).alias("unverified_claims"))
    r = stats_by_type(relationships, claims, documents).groupBy("session_id").agg(F.sum("n").alias("relationships"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("relationship_type", "n")))).alias("relationships_by_type"))
    out = sessions.select(F.col("id").alias("session_id")).join(d, "session_id", "left").join(c, "session_id", "left").join(r, "session_id", "left")
    return out.fillna(0, ["documents", "verified_claims", "unverified_claims", "relationships"])


def stats_by_type(relationships: DataFrame, claims: DataFrame, documents: DataFrame) -> DataFrame:
    return list_relationships(relationships, claims, documents).groupBy("session_id", "relationship_type").agg(F.count("*").alias("n"))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*map(filled, columns))


def search(df: DataFrame, query: str, *columns: Column) -> DataFrame:
    """Rows whose joined texts contain the query, without case; an empty query keeps all."""
    needle = query.strip().lower()
    return df.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle))) if needle else df


#: The facets that always come first.
FACETS = ("all", "corroborates", "contradicts", "reconciles")


def type_facets(relationships: DataFrame) -> DataFrame:
    """facet, position: the fixed facets, then other types by name."""
    fixed = F.array(*map(F.lit, FACETS))
    known = relationships.sparkSession.range(1).select(F.posexplode(fixed).alias("position", "facet"))
    others = relationships.select(F.lower("relationship_type").alias("facet")).distinct().filter(~F.array_contains(fixed, F.col("facet")))
    return known.select("facet", "position").unionByName(others.select("facet", (F.row_number().over(Window.orderBy("facet")) + len(FACETS) - 1).alias("position")))


def status_bucket(status: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("")))
    has = lambda *words: F.regexp_like(s, F.lit("|".join(words)))
    return F.when(has("fail", "error"), "failed").when(has("complete", "done", "success", "ready") | s.isin("processed", "finished"), "complete").when(has("processing", "extracting", "pending", "queue", "uploading") | (s == "parsed"), "processing").otherwise("complete")


def short_id(c: Column) -> Column:
    return F.substr(c, F.lit(1), F.lit(8))


def type_label(kind: Column) -> Column:
    lower = F.lower(F.coalesce(kind, F.lit("unknown")))
    words = F.replace(lower, F.lit("_"), F.lit(" "))
    return F.when(lower.isin("", "unknown"), "Unclassified").otherwise(F.concat(F.upper(F.left(words, F.lit(1))), F.substr(words, F.lit(2))))


def _aliased(df: DataFrame, *names: str) -> Column:
    """The first of the columns that are there and not null; an empty string counts as given."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def normalize_sessions(raw: DataFrame) -> DataFrame:
    return raw.withColumn("id", _aliased(raw, "id", "session_id").cast("string"))


def normalize_documents(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"id": _aliased(raw, "id", "document_id").cast("string"), "filename": _aliased(raw, "filename", "file_name", "name"), "created_at": _aliased(raw, "created_at", "uploaded_at")})


def normalize_relationships(raw: DataFrame) -> DataFrame:
    """Lower-cased type, claim ids and reasoning as strings that are never null."""
    kind = F.lower(F.coalesce(_aliased(raw, "relationship_type", "type"), F.lit("unknown")))
    text = lambda *names: F.coalesce(_aliased(raw, *names).cast("string"), F.lit(""))
    return raw.withColumns({"type": kind, "claim_a_id": text("source_claim_id"), "claim_b_id": text("target_claim_id"), "reasoning": text("explanation", "reasoning", "rationale")})


def normalize_claims(raw: DataFrame) -> DataFrame:
    """Claims as a reader shows them: boolean verified, page 0 as none, evidence as an array."""
    source = F.coalesce(_aliased(raw, "source_text", "text", "claim_text", "content", "statement"), F.lit(""))
    page = F.nullif(_aliased(raw, "source_page", "page").cast("int"), F.lit(0))
    evidence = F.when(source == "", F.array()).otherwise(F.array(F.struct(source.alias("text"), page.alias("page"))))
    return raw.withColumns({"evidence": evidence, "evidence_count": F.when(source == "", 0).otherwise(1), "verified": F.coalesce(F.col("verified").cast("boolean"), F.lit(False))})


#: Fixed value: the name of a document that isn't known.
UNKNOWN_DOCUMENT = "Unknown document"


def document_names(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims with ``document_name``: their own where filled, else the document's filename, else the fixed name."""
    named = documents.select(F.col("id").alias("document_id"), F.col("filename").alias("_filename"))
    return claims.join(named, "document_id", "left").withColumn("document_name", F.coalesce(filled(F.col("document_name")), filled(F.col("_filename")), F.lit(UNKNOWN_DOCUMENT))).drop("_filename")


def filter_relationships(relationships: DataFrame, kind: str = "all", query: str = "") -> DataFrame:
    """Rows of ``list_relationships`` of one type (or all) whose claims, document names, reasoning or evidence hold the query."""
    out = relationships if kind == "all" else relationships.filter(F.lower("relationship_type") == kind)
    texts = [F.col(f"claim_{s}.{c}") for c in ("source_text", "document_name") for s in "ab"]
    return search(out, query, *map(filled, [*texts[:2], *texts[2:], F.col("explanation"), *texts[:2]]))


def positions(df: DataFrame, key: str, at: str = "created_at") -> DataFrame:
    """Rows with ``position``, their place in the key's list, newest first."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), "id")))


def clean_query(text: Column) -> Column:
    return F.lower(ustrip(text))
