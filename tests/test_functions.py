"""Functions against hand-worked values."""

import pytest
from pyspark.sql import functions as F

from proofmill.functions import periods as P
from proofmill.functions import similarity as S
from proofmill.functions import text as X
from proofmill.functions import units as U
from proofmill.operators.adjudicate import is_limit, parse_claims, parse_verdicts, retry_wait


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("given,want", [("Apple Inc.", "apple inc "), ("₹ million", " million"), (None, ""), ("  A\n\tB%  ", "a b%"), ("É-x", " x")])
def test_normalize(spark, given, want):
    got = spark.createDataFrame([(given,)], "t string").select(X.normalize(F.col("t")).alias("x")).first().x
    assert got == want


def test_tokens_and_estimates(spark):
    df = spark.createDataFrame([("The net sales of A % rose rose",)], "t string")
    row = df.select(X.tokens(X.normalize(F.col("t"))).alias("a"), X.meaningful(X.normalize(F.col("t"))).alias("b"), X.cues(X.meaningful(X.normalize(F.col("t")))).alias("c"), X.token_estimate(F.col("t")).alias("d")).first()
    assert row.a == ["the", "net", "sales", "of", "a", "%", "rose"]
    assert sorted(row.b) == ["net", "rose", "sales"]
    assert row.c == ["rose"]
    assert row.d == 8


def test_verify_normalize(spark):
    assert one(spark, X.verify_normalize(F.col("t")), t="  “A”–b’s  x ") == "\"a\"-b's x"


@pytest.mark.parametrize(
    "unit,key",
    [("₹ crore", "inr_croreore"), ("₹ cr", "inr_crore"), ("US$ million", "ususd_million"), ("$ million", "usd_million"), ("us dollars", "us_dollainr"), ("us dollar", "usd"), ("billion USD", "usd_billion"), ("$million", "usdmillion")],
)
def test_unit_key(spark, unit, key):
    assert one(spark, U.unit_key(F.col("u")), u=unit) == key


@pytest.mark.parametrize("unit,key", [("₹ crore", "inr_crore"), ("US$ million", "usd_million"), ("us dollars", "usd"), ("$million", "usd_million"), ("rs. lakhs", "inr_lakh")])
def test_strict_unit_key(spark, unit, key):
    assert one(spark, U.unit_key(F.col("u"), strict_units=True), u=unit) == key


@pytest.mark.parametrize(
    "a,ua,b,ub,want",
    [
        (394.0, "billion USD", 394.0, "billion USD", "EXACT_MATCH"),
        (1266.0, "₹ million", 126.6, "₹ cr", "UNIT_NORMALIZATION"),
        (100.0, "usd", 101.0, "usd", "ROUNDING"),
        (100.0, "usd", 120.0, "usd", "NUMERIC_DISCREPANCY"),
        (1.0, "usd", 1.0, "inr", "UNIT_INCOMPATIBLE"),
        (1.0, "percent", 1.0, "percent", "UNIT_UNRECOGNIZED"),
    ],
)
def test_values_match(spark, a, ua, b, ub, want):
    assert one(spark, U.value_reason(F.col("a"), U.unit_key(F.col("ua")), F.col("b"), U.unit_key(F.col("ub"))), a=a, ua=ua, b=b, ub=ub) == want


@pytest.mark.parametrize("a,b,want", [("billion USD", "percent", False), ("usd", "percent", True), (None, "percent", True), ("rs", "crore", True), ("times", "number", False)])
def test_same_unit(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(U.same_unit(F.col("a"), F.col("b")).alias("x")).first().x is want


@pytest.mark.parametrize(
    "raw,kind,label,quarter",
    [("FY2024-25", "FY", "FY25", None), ("FY25", "FY", "FY25", None), ("2024-01-01 2024-12-31", "FY", "FY01", None), ("Q2 FY24", "quarter", "FY24", "Q2"), ("full year", "FY", None, None), ("jan", "month", None, None), ("", None, None, None)],
)
def test_period(spark, raw, kind, label, quarter):
    p = one(spark, P.normalize_period(F.col("r")), r=raw)
    assert (p.period_type, p.fy_label, p.quarter) == (kind, label, quarter)


@pytest.mark.parametrize("a,b,want", [("Q1", "full year", False), ("FY24", "FY2024", True), ("FY24", "FY25", False), ("Q1 FY24", "Q1", True)])
def test_comparable(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(P.normalize_period(F.col("a")).alias("a"), P.normalize_period(F.col("b")).alias("b"))
    assert df.select(P.comparable(F.col("a"), F.col("b")).alias("x")).first().x is want


def test_sequence_ratio_depends_on_order(spark):
    df = spark.createDataFrame([("apple inc", "microsoft corporation"), ("microsoft corporation", "apple inc"), ("", "a")], "a string, b string")
    got = [round(r.x, 3) for r in df.select(S.sequence_ratio("a", "b").alias("x")).collect()]
    assert got == [0.2, 0.133, 0.0]


def test_parse_verdicts(spark):
    good = '{"p1": {"relationship_type": "CONTRADICTS", "confidence": 0.7}, "p2": 5}'
    rows = spark.createDataFrame([(1, ["p1", "p2"], good), (2, ["p3"], '{"p3": {}, "p9": {}}'), (3, ["p4"], "no json")], "batch_id int, pair_ids array<string>, response string")
    got = {r.pair_id: r.verdict.relationship_type for r in parse_verdicts(rows).collect()}
    assert got == {"p1": "CONTRADICTS", "p2": "UNCERTAIN", "p3": "UNCERTAIN", "p4": "UNCERTAIN"}


def test_parse_claims(spark):
    response = '[{"block_id": "b", "subject": "s", "predicate": "p", "evidence_quote": "q"}, {"subject": "s"}, 3]'
    got = parse_claims(spark.createDataFrame([("r", response), ("x", "{}")], "id string, response string")).collect()
    assert [(r.id, r.subject, r.confidence) for r in got] == [("r", "s", 0.5)]


def test_limits():
    assert is_limit("Error 429") and not is_limit("bad request") and [retry_wait(k) for k in range(3)] == [5, 10, 20]
