"""Claim pairs: enumeration in a session, undirected keys, scores and candidates.

Everything a pair needs of one claim is prepared once per claim, before the join.
The sequence ratio is the only Python step; pairs that the set measures decide
alone never reach it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.functions import similarity as S
from proofmill.functions import text as X
from proofmill.functions import units as U

THRESHOLD = 18.0
TOP = 150

#: Other names of metrics.
SYNONYMS = {
    "sales": "revenue",
    "net sales": "revenue",
    "total sales": "revenue",
    "total revenue": "revenue",
    "revenues": "revenue",
    "turnover": "revenue",
    "earnings": "profit",
    "net earnings": "profit",
    "net income": "profit",
    "net profit": "profit",
    "operating earnings": "operating profit",
    "operating income": "operating profit",
    "cash and cash equivalents": "cash balance",
    "cash equivalents": "cash balance",
    "imports": "imports",
    "import value": "imports",
    "import volume": "imports",
    "exports": "exports",
    "export value": "exports",
    "export volume": "exports",
    "tariff rate": "tariff",
    "tariff rates": "tariff",
    "customs duty": "tariff",
    "customs duties": "tariff",
    "inflation rate": "inflation",
    "consumer price inflation": "inflation",
    "employment rate": "employment",
    "unemployment rate": "unemployment",
}
#: Compared by sequence and token sets; the columns of ``prepared`` are named after them.
FIELDS = ("subject", "predicate", "definition", "basis", "scope", "period")


def canonical(normal: Column) -> Column:
    known = F.create_map(*(F.lit(x) for item in SYNONYMS.items() for x in item))
    return F.coalesce(F.element_at(known, normal), normal)


def prepared(claims: DataFrame) -> DataFrame:
    """Claims with normal forms (n_), sequence forms (s_), tokens (t_) of FIELDS, and the tokens of the whole claim."""
    text = {f: F.col(f) for f in FIELDS[:-1]} | {"period": X.period_text(F.col)}
    out = claims.withColumns({f"n_{f}": X.normalize(c) for f, c in text.items()} | {"period": text["period"]})
    out = out.withColumn("n_predicate", canonical(F.col("n_predicate")))
    out = out.withColumns({f"s_{f}": X.ustrip(F.col(f"n_{f}")) for f in FIELDS} | {f"t_{f}": X.meaningful(F.col(f"n_{f}")) for f in FIELDS})
    return out.withColumn("t_claim", X.meaningful(X.normalize(X.claim_text(F.col)))).withColumn("t_cues", X.cues(F.col("t_claim")))


def ordered(claims: DataFrame) -> DataFrame:
    """Claims with ``ord``, their place in the session by creation; it fixes every pair's direction."""
    return claims.withColumn("ord", F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id")))


def enumerate_pairs(claims: DataFrame) -> DataFrame:
    """Pairs (a, b) of structs of one session, a before b, of different documents."""
    a = claims.select("session_id", F.struct(*claims.columns).alias("a"))
    b = claims.select("session_id", F.struct(*claims.columns).alias("b"))
    apart = (F.col("a.ord") < F.col("b.ord")) & ~(X.filled(F.col("a.document_id")) == X.filled(F.col("b.document_id"))).eqNullSafe(True)
    return a.join(b, "session_id").filter(apart)


def undirected(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def new_pairs(pairs: DataFrame, relationships: DataFrame) -> DataFrame:
    """Pairs without a stored relationship in either direction."""
    lo, hi = undirected(F.col("source_claim_id"), F.col("target_claim_id"))
    stored = relationships.select(lo.alias("lo"), hi.alias("hi")).distinct()
    lo, hi = undirected(F.col("a.id"), F.col("b.id"))
    return pairs.withColumns({"lo": lo, "hi": hi}).join(stored, ["lo", "hi"], "left_anti").drop("lo", "hi")


def dedup_undirected(results: DataFrame, first: list) -> DataFrame:
    """One row of each undirected (source_claim_id, target_claim_id), the first in ``first`` order; rows without ids are dropped."""
    lo, hi = undirected(F.col("source_claim_id"), F.col("target_claim_id"))
    real = results.filter("source_claim_id is not null and target_claim_id is not null")
    return real.withColumn("rn", F.row_number().over(Window.partitionBy(lo, hi).orderBy(*first))).filter("rn = 1").drop("rn")


def _both(field: str, prefix: str) -> tuple[Column, Column]:
    return F.col(f"a.{prefix}_{field}"), F.col(f"b.{prefix}_{field}")


def measured(pairs: DataFrame) -> DataFrame:
    """Pairs with every measure that needs no sequence ratio, each worked out once.

    For each of FIELDS: m_ the larger set measure, gone_ whether a side is missing, even_ whether both are
    equal and so alike in full; for subject and predicate close_, whether the sets alone make them the same.
    """
    out = pairs
    for f in FIELDS:
        (ta, tb), (na, nb) = _both(f, "t"), _both(f, "n")
        out = out.withColumns({f"j_{f}": S.jaccard(ta, tb), f"c_{f}": S.containment(ta, tb)})
        if f in ("subject", "predicate"):
            gone, even = (na == "") | (nb == ""), na == nb
        else:
            gone = X.filled(F.col(f"a.{f}")).isNull() | X.filled(F.col(f"b.{f}")).isNull()
            even = (F.col(f"a.{f}") == F.col(f"b.{f}")) if f == "period" else F.lit(False)
        out = out.withColumns({f"m_{f}": F.greatest(f"j_{f}", f"c_{f}"), f"gone_{f}": gone, f"even_{f}": even})
        if f in ("subject", "predicate"):
            out = out.withColumn(f"close_{f}", ~F.col(f"gone_{f}") & (F.col(f"even_{f}") | (F.col(f"j_{f}") >= 0.40) | (F.col(f"c_{f}") >= 0.60)))
    return out.withColumns(
        {
            "m_shared": F.size(F.array_intersect("a.t_claim", "b.t_claim")),
            "m_cues": F.size(F.array_intersect("a.t_cues", "b.t_cues")),
            "m_unit": U.same_unit(F.col("a.unit"), F.col("b.unit")).cast("double"),
            "m_kind": U.same_value_type(F.col("a.value_type"), F.col("b.value_type")).cast("double"),
        }
    )


def _kept(df: DataFrame, condition: str) -> DataFrame:
    """Filter on computed columns without the optimizer copying their whole expressions into the condition."""
    return df.withColumn("_row", F.monotonically_increasing_id()).filter(f"{condition} and _row >= 0").drop("_row")


def _unmeasured(df: DataFrame) -> DataFrame:
    names = [f"{p}_{f}" for f in FIELDS for p in ("j", "c", "m", "gone", "even", "close")]
    return df.drop(*names, "m_shared", "m_cues", "m_unit", "m_kind")


def _same(field: str, ratio: Column) -> Column:
    return F.col(f"close_{field}") | (~F.col(f"gone_{field}") & (ratio >= 0.75))


def _likeness(field: str, ratio: Column) -> Column:
    return F.when(F.col(f"gone_{field}"), 0.0).when(F.col(f"even_{field}"), 1.0).otherwise(F.greatest(ratio, f"m_{field}"))


def score(ratio: dict[str, Column], same_subject: Column | None = None) -> Column:
    """Score and reason of a measured pair, given the sequence ratio of each field (or a bound of it)."""
    like = {f: _likeness(f, ratio[f]) for f in FIELDS}
    shared, cue, unit, kind = (F.col(f"m_{x}") for x in ("shared", "cues", "unit", "kind"))
    d, b, s, p = (like[f] for f in ("definition", "basis", "scope", "period"))
    subject = _same("subject", ratio["subject"]) if same_subject is None else same_subject
    close = 70 + 12 * d + 5 * b + 5 * s + 8 * p + 1.5 * F.least(shared, F.lit(5)) + 3 * unit + 2 * kind
    related = 45 + 12 * like["predicate"] + 12 * d + 5 * b + 5 * s + 6 * p + 2 * F.least(shared, F.lit(5)) + 3 * F.least(cue, F.lit(3)) + 2 * unit + kind
    base = F.when(shared >= 4, 28).when(shared == 3, 23).when(shared == 2, 16).when(shared == 1, 5).otherwise(0)
    context = base + 12 * like["subject"] + 8 * like["predicate"] + 18 * d + 5 * b + 5 * s + 5 * p + 4 * F.least(cue, F.lit(3)) + 2 * unit + kind
    both = subject & _same("predicate", ratio["predicate"])
    value = F.when(both, close).when(subject, related).otherwise(context)
    reason = F.when(both, "same_subject_and_predicate").when(subject, "same_subject_related_predicate").otherwise("shared_context")
    return F.struct(value.cast("double").alias("score"), reason.alias("reason"))


def _guarded(scored: Column) -> Column:
    """Scores of pairs of one claim, of one document or under the threshold are 0."""
    zero = lambda reason: F.struct(F.lit(0.0).alias("score"), F.lit(reason).alias("reason"))
    a, b = X.filled(F.col("a.document_id")), X.filled(F.col("b.document_id"))
    return F.when(F.col("a.id").eqNullSafe(F.col("b.id")), zero("same_claim")).when((a == b).eqNullSafe(True), zero("same_document")).when(scored["score"] < THRESHOLD, zero("below_threshold")).otherwise(scored)


def _scored(pairs: DataFrame, open_: Column | None = None) -> DataFrame:
    """Measured pairs with ``score`` and ``reason``; where not ``open_``, no ratio is worked out and the score is too low."""
    side = lambda c: c if open_ is None else F.when(open_, c)
    ratios = {f"r_{f}": S.sequence_ratio(*map(side, _both(f, "s"))) for f in FIELDS}
    out = pairs.withColumns(ratios).withColumn("scored", score({f: F.col(f"r_{f}") for f in FIELDS})).withColumn("scored", _guarded(F.col("scored")))
    return out.select("*", "scored.score", "scored.reason").drop("scored", *ratios)


def pair_scores(pairs: DataFrame) -> DataFrame:
    """Pairs of prepared claims with ``score`` and ``reason``."""
    return _unmeasured(_scored(measured(pairs)))


def candidate_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose score is above 0; only those that bounds leave open are scored with sequence ratios."""
    low = {f: F.lit(0.0) for f in FIELDS}
    high = {f: S.ratio_bound(*_both(f, "s")) for f in FIELDS}
    bounded = measured(pairs.filter(~F.col("a.id").eqNullSafe(F.col("b.id")))).withColumn("least", score(low, F.lit(False))["score"]).withColumn("most", score(high, F.lit(False))["score"])
    state = F.when(F.col("close_subject") | (F.col("least") >= THRESHOLD + 1e-9), "in").when((high["subject"] < 0.75 - 1e-9) & (F.col("most") < THRESHOLD - 1e-9), "out").otherwise("open")
    staged = _kept(bounded.withColumn("state", state).drop("least", "most"), "state <> 'out'")
    # decided pairs pass by with nulls, so the pairs are made once
    scored = _scored(staged, F.col("state") == "open")
    return _unmeasured(_kept(scored, "(state = 'in' or score > 0)").drop("score", "reason", "state"))
