"""Claims, documents and relationships derived from the order tables.

Each group of ``GROUP`` suppliers is a session with four publishers' documents. A
document claims the yearly sales of each supplier of the group, each publisher in
its own unit, rounding, metric name, scope and basis. So sessions, claims and pairs
grow with the tables, and a session stays bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.functions.text import upper_single

BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder. Rows go to Python in batches of a few MB, unless the session says otherwise."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


GROUP = 4


def _session(key: str) -> Column:
    return F.concat(F.lit("S"), F.floor(F.col(key) / GROUP).cast("string"))


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, subject (nation and number of a supplier), year and total of sales."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    by_supplier = lines.groupBy("l_suppkey", "year").agg(F.sum("price").cast("double").alias("total"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    named = by_supplier.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select(_session("l_suppkey").alias("session_id"), F.concat_ws(" ", "n_name", F.col("l_suppkey").cast("string")).alias("subject"), "year", "total")


#: Publisher, metric, unit, divisor, decimal steps, scope and its first year, basis of even years, kind of order value.
PUBLISHERS = [
    ("A", "revenue", "million USD", 1e6, 1e4, None, None, "GAAP", "gross"),
    ("B", "revenue", "billion USD", 1e9, 1e6, None, None, "GAAP", "gross"),
    ("C", "net sales", "$ million", 1e6, 1e2, "Domestic", 1998, "Non-GAAP", "gross"),
    ("D", "revenue", "million USD", 1e6, 1e2, "Export", 1999, "Non-GAAP", "net"),
]
_FIELDS = ("name", "metric", "unit", "divisor", "steps", "scope", "since", "basis", "kind")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with session_id; created_at grows with the id of a document."""
    each = F.explode(F.array(*(F.struct(*(F.lit(v).cast("int" if n == "since" else "double" if n in ("divisor", "steps") else "string").alias(n) for n, v in zip(_FIELDS, p, strict=True))) for p in PUBLISHERS)))
    p = lambda n: F.col(f"p.{n}")
    year, labelled = F.col("year").cast("string"), p("name") == "C"
    return yearly(spark, sf_dir).withColumn("p", each).select(
        "session_id",
        F.concat_ws("-", "session_id", p("name")).alias("document_id"),
        F.concat_ws("-", "session_id", p("name"), "subject", year).alias("id"),
        "subject",
        p("metric").alias("predicate"),
        (F.floor(F.col("total") / p("divisor") * p("steps")) / p("steps")).alias("value"),
        F.lit("numeric").alias("value_type"),
        p("unit").alias("unit"),
        F.when(labelled, F.concat(F.lit("FY"), year)).otherwise(F.concat(year, F.lit("-01-01"))).alias("period_start"),
        F.when(~labelled, F.concat(year, F.lit("-12-31"))).alias("period_end"),
        F.lit("FY").alias("period_type"),
        F.when(F.col("year") >= p("since"), p("scope")).alias("scope"),
        F.when(F.col("year") % 2 == 0, p("basis")).alias("basis"),
        F.when(F.col("year") >= 2000, F.concat_ws(" ", F.lit("order value"), p("kind"))).alias("definition"),
        F.lit("metric").alias("claim_type"),
        (F.col("year") - 1990).cast("int").alias("source_page"),
        F.concat_ws(" ", F.lit("Orders of"), "subject", F.lit("in"), year).alias("source_text"),
        (F.col("year") != 1997).alias("verified"),
        F.lit(0.9).alias("confidence"),
        F.concat_ws("-", p("name"), "subject", year).alias("created_at"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(_session("s_suppkey").alias("id"), F.lit("active").alias("status")).distinct()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publishers' documents: id, session_id, filename, status."""
    each = sessions(spark, sf_dir).select(F.col("id").alias("session_id"), F.explode(F.array(*(F.lit(p[0]) for p in PUBLISHERS))).alias("publisher"))
    return each.select(F.concat_ws("-", "session_id", "publisher").alias("id"), "session_id", F.concat(F.lower("publisher"), F.lit(".pdf")).alias("filename"), F.when(F.col("publisher") == "D", "parsed").otherwise("extracted").alias("status"))


def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ``documents`` as evidence blocks of the ledger's documents: id, document_id, page, block_type, text."""
    docs = table(spark, sf_dir, "documents")
    publisher = F.element_at(F.array(*(F.lit(p[0]) for p in PUBLISHERS)), (F.col("doc_id") % len(PUBLISHERS) + 1).cast("int"))
    document = F.concat(F.lit("S"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit("-"), publisher)
    return docs.select(F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("id"), document.alias("document_id"), (F.col("doc_id") % 50 + 1).cast("int").alias("page"), F.lit("TEXT").alias("block_type"), "text", "doc_id")


def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an extractor would answer for the blocks: a claim each with a quote, one in eleven of a block that isn't there."""
    blocks = evidence_blocks(spark, sf_dir).select("id", "document_id", "doc_id", "text")
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    quote = F.when(k % 3 == 0, F.replace(F.substr(text, F.lit(11), F.lit(70)), F.lit(" "), F.lit("\n "))).when(k % 3 == 1, upper_single(F.substr(text, F.lit(1), F.lit(12)))).otherwise(F.lit("no such words"))
    return blocks.select(
        F.concat(F.lit("r"), k.cast("string")).alias("id"),
        F.when(k % 11 == 10, F.concat(F.lit("gone"), k.cast("string"))).otherwise(F.col("id")).alias("block_id"),
        "document_id",
        F.concat(F.lit("subject "), (k % 7).cast("string")).alias("subject"),
        F.lit("mentions").alias("predicate"),
        k.cast("double").alias("value"),
        quote.alias("evidence_quote"),
        F.when(k % 5 != 0, 0.75).alias("confidence"),
    )


def extractor_answers(batched: DataFrame) -> DataFrame:
    """What an extractor might answer to each batch of blocks (id, document_id, page, seq, text, batch_id): half of it is unusable.

    A quarter of the answers breaks off, another quarter is no array. In the others one item in six has no subject, one
    names no block, one has a value that is no number and one a predicate that is no text. Blocks count from 1 in a document.
    """
    doc = F.col("document_id").cast("long")
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "seq"))
    kind, own = F.col("nth") % 6, (F.col("nth") % 6 == 1) & (doc % 10 == 0)
    quote = F.when(own, F.substr("text", F.lit(1), F.lit(40))).otherwise("no such words")
    item = lambda value, predicate: F.to_json(
        F.struct(
            F.when(kind == 4, "nowhere").otherwise(F.col("id")).alias("block_id"),
            F.when(kind != 3, F.concat(F.lit("subject "), (doc % 7).cast("string"))).alias("subject"),
            predicate.alias("predicate"),
            value.alias("value"),
            F.lit("usd").alias("unit"),
            quote.alias("evidence_quote"),
            F.when(kind == 1, 0.75).alias("confidence"),
        )
    )
    named = F.lit("mentions")
    text = (
        F.when(kind == 2, item(F.lit("12.5"), named)).when(kind == 5, item(F.lit("many"), named)).when(kind == 0, item(F.col("nth"), F.lit(7))).otherwise(item((doc % 50).cast("double"), named))
    )
    each = F.array_sort(F.collect_list(F.struct("nth", text.alias("text"))))
    array = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["text"]), ", "), F.lit("]"))
    whole = batched.withColumn("nth", nth).groupBy("document_id", "batch_id").agg(each.alias("items")).withColumn("whole", array)
    way = (doc + F.col("batch_id")) % 4
    cut = F.expr("substr(whole, 1, length(whole) - 3)")
    return whole.select("document_id", "batch_id", F.when(way == 2, cut).when(way == 3, '{"claims": []}').otherwise(F.col("whole")).alias("response"))


def adjudicator_answers(batched: DataFrame) -> DataFrame:
    """What an adjudicator might answer to each batch of pairs: every second batch is unusable, and in every fourth one pair is."""
    nth = F.substr("pair_id", F.lit(6)).cast("int")
    kind = F.when(nth % 3 == 0, "CONTRADICTS").otherwise("UNCERTAIN")
    verdict = F.to_json(F.struct(kind.alias("relationship_type"), F.lit("CHECKED").alias("reason_code"), F.when(nth % 3 != 1, "as told").alias("explanation"), F.lit(0.5).alias("confidence")))
    told = F.when((F.col("batch_id") % 4 == 3) & (nth % 10 == 0), '"unclear"').otherwise(verdict)
    entry = F.concat(F.lit('"'), "pair_id", F.lit('": '), told)
    left_out = (F.col("batch_id") % 4 == 2) & (nth % 10 == 0)
    each = F.array_sort(F.collect_list(F.when(~left_out, F.struct(nth.alias("nth"), entry.alias("text")))))
    whole = batched.groupBy("session_id", "batch_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(each, lambda x: x["text"]), ", "), F.lit("}")).alias("whole"))
    return whole.select("session_id", "batch_id", F.when(F.col("batch_id") % 4 == 1, F.expr("substr(whole, 1, length(whole) - 3)")).otherwise(F.col("whole")).alias("response"))
