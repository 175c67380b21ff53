"""The rule cascade that decides a pair, or leaves it open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions import periods as P
from proofmill.functions import text as X
from proofmill.functions import units as U

#: What an adjudicator that isn't there answers.
OFFLINE = {"relationship_type": "UNCERTAIN", "reason_code": "INSUFFICIENT_CONTEXT", "explanation": "Batched Gemini adjudication failed or returned invalid JSON.", "confidence": 0.0, "decided_by": "llm"}


def _verdict(kind: str, reason: Column, explanation: Column, confidence: float) -> Column:
    return F.struct(F.lit(kind).alias("relationship_type"), reason.alias("reason_code"), explanation.alias("explanation"), F.lit(confidence).alias("confidence"), F.lit("rules").alias("decided_by"))


def prepared(claims: DataFrame, strict_units: bool = False) -> DataFrame:
    """Claims with what the rules compare, worked out once a claim: rule_<field>, rule_period, rule_unit, rule_key, rule_currency, rule_base."""
    period = F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in ("period_start", "period_end", "period_type")))
    known = claims.withColumns(
        {f"rule_{f}": X.rule_normalize(F.col(f)) for f in ("subject", "predicate", "scope", "basis", "definition")}
        | {"rule_period": P.normalize_period(period), "rule_key": U.unit_key(F.col("unit"), strict_units), "rule_unit": X.filled(F.col("unit")), "rule_start": X.filled(F.col("period_start")), "rule_end": X.filled(F.col("period_end"))}
    )
    return known.withColumns({"rule_currency": U.currency(F.col("rule_key")), "rule_base": F.col("value") * U.factor(F.col("rule_key"))})


def verdict() -> Column:
    """The verdict of pair (a, b) of prepared claims, null where the rules leave it open."""
    a, b = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    differ = lambda f: (a(f"rule_{f}") != "") & (b(f"rule_{f}") != "") & (a(f"rule_{f}") != b(f"rule_{f}"))
    unlike = lambda f: (a(f"rule_{f}") == "") | (a(f"rule_{f}") != b(f"rule_{f}"))
    dated = a("rule_start").isNotNull() & b("rule_start").isNotNull() & a("rule_end").isNotNull() & b("rule_end").isNotNull()
    pa, pb = a("rule_period"), b("rule_period")
    reason = U.base_reason(*(side(f"rule_{f}") for side in (a, b) for f in ("base", "currency", "key")))
    valued = a("value").isNotNull() & b("value").isNotNull() & a("rule_unit").isNotNull() & b("rule_unit").isNotNull()
    note = lambda template, *parts: F.format_string(template, *parts)
    apart = "Periods differ ({} vs {}); the claims refer to different reporting periods."
    return (
        F.when(unlike("subject") | unlike("predicate"), None)
        .when(differ("scope"), _verdict("RECONCILES", F.lit("DIFFERENT_SCOPE"), note("'%s' reports the same metric on different scopes (%s vs %s).", a("subject"), a("rule_scope"), b("rule_scope")), 0.8))
        .when(dated & ((a("rule_start") != b("rule_start")) | (a("rule_end") != b("rule_end"))), _verdict("RECONCILES", F.lit("DIFFERENT_PERIOD"), note(apart.format("%s to %s", "%s to %s"), a("period_start"), a("period_end"), b("period_start"), b("period_end")), 0.85))
        .when(~dated & ~P.comparable(pa, pb), _verdict("RECONCILES", F.lit("DIFFERENT_PERIOD"), note(apart.format("%s", "%s"), pa["raw"], pb["raw"]), 0.85))
        .when(differ("basis") | differ("definition"), None)
        .when(valued & U.agrees(reason), _verdict("CORROBORATES", reason, note("Values agree once normalized to a common unit (%s).", F.lower(reason)), 0.9))
    )


def decide(pairs: DataFrame) -> DataFrame:
    """Pairs of prepared claims with ``verdict``."""
    return pairs.withColumn("verdict", verdict())


def _apart() -> Column:
    return (F.col("a.ord") < F.col("b.ord")) & ~(X.filled(F.col("a.document_id")) == X.filled(F.col("b.document_id"))).eqNullSafe(True)


#: Rows of one session, subject and predicate that one task pairs with all of the others.
PART = 512


def compared(claims: DataFrame) -> DataFrame:
    """Claims with ``rule``, all that a verdict looks at."""
    p = prepared(claims)
    kept = [c for c in p.columns if c.startswith("rule_")]
    return p.withColumn("rule", F.struct("subject", "value", "period_start", "period_end", *kept)).drop(*kept)


def _alike(rows: DataFrame, apart: Column) -> DataFrame:
    """session_id, a, b, verdict: the pairs ``apart`` of rows (with ``ord`` and ``rule``) of one session with equal, filled subject and predicate; the rules decide no others.

    Many rows of one subject and predicate are cut in parts, each of which meets all of them in a task of its own; a part's
    pairs are many more than its bytes tell, so the number of tasks is given.
    """
    spread = [c for c in rows.columns if c != "rule"]
    known = rows.select(*spread, "rule.*").filter("rule_subject <> '' and rule_predicate <> ''")
    keys = ["session_id", "rule_subject", "rule_predicate"]
    group = Window.partitionBy(*keys)
    counted = known.select("*", F.row_number().over(group.orderBy("ord")).alias("nth"), F.count("*").over(group).alias("many"))
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    part, parts = F.floor((F.col("nth") - 1) / PART), F.sequence(F.lit(0), F.floor((F.col("many") - 1) / PART))
    side = lambda s, p: counted.withColumn("part", p).repartition(tasks, *keys, "part").select(*keys, "part", F.struct(*known.columns).alias(s))
    return decide(side("a", part).join(side("b", F.explode(parts)), [*keys, "part"]).filter(apart))


def _claims(claims: DataFrame) -> DataFrame:
    return compared(claims).select("session_id", "ord", "id", "document_id", "rule")


def ruled(claims: DataFrame) -> DataFrame:
    """session_id, a, b, verdict: the pairs of claims (with ``ord``) of one session that the rules decide.

    The rules decide only pairs of equal, filled subject and predicate, so those are join keys; a and b hold what the rules compare.
    """
    return _alike(_claims(claims), _apart()).filter("verdict is not null").select("session_id", "a", "b", "verdict")


def ruled_kinds(kinds: DataFrame) -> DataFrame:
    """The same of kinds (with ``rule``), by their ``first`` claim: what the rules decide of pairs whose claim of a is earlier than that of b."""
    rows = kinds.select("session_id", F.col("first").alias("ord"), "last", "block", "rule")
    return _alike(rows, F.col("a.ord") < F.col("b.last")).filter("verdict is not null").select("session_id", "a", "b", "verdict")


def left_open(claims: DataFrame) -> DataFrame:
    """session_id, ord_a, ord_b, id_a, id_b: all other pairs of claims (with ``ord``) of one session and different documents.

    Pairs of unlike subject or predicate are open whatever else they hold, so nothing else of them is looked at.
    """
    told = ["session_id", *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("ord", "id") for s in "ab")]
    undecided = _alike(_claims(claims), _apart()).filter("verdict is null").select(told)
    narrow = claims.select("session_id", "ord", "id", "document_id", *(X.rule_normalize(F.col(f)).alias(f"rule_{f}") for f in ("subject", "predicate")))
    side = lambda s: narrow.select("session_id", F.struct(*narrow.columns).alias(s))
    same = lambda f: (F.col(f"a.rule_{f}") != "") & (F.col(f"a.rule_{f}") == F.col(f"b.rule_{f}"))
    unlike = side("a").join(side("b"), "session_id").filter(_apart() & ~(same("subject") & same("predicate")))
    return unlike.select(told).unionByName(undecided)


def partition(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs that the rules decided, and those for the adjudicator."""
    return decided.filter("verdict is not null"), decided.filter("verdict is null")


def offline(undecided: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """The deterministic default adjudicator; it looks at no claim."""
    return undecided.withColumn("verdict", uncertain())


def uncertain() -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in OFFLINE.items()))
