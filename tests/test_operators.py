"""Pairs, verdicts, verification, folds, store and stream on small claims."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from proofmill.operators import batching, ledger, pairs, store, verdict, verify
from proofmill.operators.verify import best_window
from proofmill.plans import ingest as ingest_plan
from proofmill.plans.link import link_sessions
from proofmill.sources.schemas import CLAIMS
from proofmill.streaming import ingest

BASE = {"session_id": "s", "subject": "Apple Inc.", "predicate": "revenue", "value": 394.0, "value_type": "numeric", "unit": "billion USD", "verified": True}
FIELDS = ["id", "document_id", "session_id", "subject", "predicate", "value", "value_type", "unit", "period_start", "period_end", "period_type", "scope", "basis", "definition", "claim_type", "source_page", "source_text", "verified", "created_at"]
SCHEMA = ", ".join(f"{f} {'double' if f == 'value' else 'boolean' if f == 'verified' else 'int' if f == 'source_page' else 'string'}" for f in FIELDS)


def claims(spark, *changes):
    rows = []
    for i, change in enumerate(changes):
        row = BASE | {"id": str(i), "document_id": f"doc{i}", "created_at": f"{i:03}"} | change
        rows.append(tuple(row.get(f) for f in FIELDS))
    return spark.createDataFrame(rows, SCHEMA)


def paired(spark, *changes):
    return pairs.enumerate_pairs(verdict.prepared(pairs.prepared(pairs.ordered(claims(spark, *changes)))))


CANDIDATES = [
    ({}, {}, True),
    ({"subject": "Company X", "predicate": "cash balance", "unit": "₹ million"}, {"subject": "Company X", "predicate": "cash balance", "unit": "₹ crore"}, True),
    ({"predicate": "net sales"}, {"subject": "Apple", "predicate": "total revenue"}, True),
    ({}, {"predicate": "cash balance"}, True),
    ({}, {"subject": "Microsoft Corporation"}, True),
    ({"subject": "Microsoft Corporation"}, {}, False),
    ({}, {"document_id": "doc0"}, False),
    ({}, {"unit": "percent"}, True),
    ({"subject": "zz", "predicate": "qq", "unit": "percent", "value_type": "x"}, {"subject": "vv", "predicate": "ww"}, False),
]


def cases(spark, pairs_):
    """Each pair of claims in a session of its own."""
    rows = [side | {"session_id": str(i), "document_id": side.get("document_id", f"doc{k}")} for i, pair in enumerate(pairs_) for k, side in enumerate(pair)]
    return paired(spark, *rows)


def test_candidates(spark):
    found = cases(spark, [(a, b) for a, b, _ in CANDIDATES])
    want = {str(i) for i, (*_, is_in) in enumerate(CANDIDATES) if is_in}
    assert {r.session_id for r in pairs.candidate_pairs(found).collect()} == want
    scored = {r.session_id: (round(r.score, 3), r.reason) for r in pairs.pair_scores(found).collect()}
    assert {s for s, (x, _) in scored.items() if x > 0} == want
    assert scored["4"] == (18.4, "shared_context")


def test_staging_loses_nothing(spark):
    names = ["Apple Inc.", "Apple", "Microsoft Corporation", "Tesla Motors", ""]
    terms = ["revenue", "net sales", "cash balance", None]
    found = paired(spark, *({"subject": n, "predicate": t, "scope": "Cloud" if i % 3 else None, "definition": f"order value {t}" if i % 2 else None} for i, (n, t) in enumerate((n, t) for n in names for t in terms)))
    full = {(r.x, r.y) for r in pairs.pair_scores(found).filter("score > 0").select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()}
    staged = {(r.x, r.y) for r in pairs.candidate_pairs(found).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()}
    assert full == staged and full


DATES = {"period_start": "2024-01-01", "period_end": "2024-12-31"}


VERDICTS = [
    (DATES, DATES, ("CORROBORATES", "EXACT_MATCH", 0.9)),
    (DATES, {"period_start": "2023-01-01", "period_end": "2023-12-31"}, ("RECONCILES", "DIFFERENT_PERIOD", 0.85)),
    ({"scope": "Cloud segment"}, {"scope": "Total company"}, ("RECONCILES", "DIFFERENT_SCOPE", 0.8)),
    ({"value": 1266.0, "unit": "₹ million"}, {"value": 126.6, "unit": "₹ crore"}, None),
    ({"value": 1266.0, "unit": "₹ million"}, {"value": 126.6, "unit": "₹ cr"}, ("CORROBORATES", "UNIT_NORMALIZATION", 0.9)),
    ({"definition": "before tax"}, {"definition": "after tax"}, None),
    ({"basis": "GAAP"}, {"basis": "Non-GAAP"}, None),
    ({"value": None}, {}, None),
    ({"unit": ""}, {}, None),
    ({"definition": "x"}, {}, ("CORROBORATES", "EXACT_MATCH", 0.9)),
    ({"value": 100.0}, {"value": 120.0}, None),
    ({"subject": ""}, {"subject": ""}, None),
    ({"predicate": "a"}, {"predicate": "b"}, None),
    ({"period_start": "Q1"}, {}, ("RECONCILES", "DIFFERENT_PERIOD", 0.85)),
    ({"value": 0.0}, {"value": 0.0}, ("CORROBORATES", "EXACT_MATCH", 0.9)),
]


def test_verdicts(spark):
    decided = verdict.decide(cases(spark, [(a, b) for a, b, _ in VERDICTS])).collect()
    got = {r.session_id: r.verdict and (r.verdict.relationship_type, r.verdict.reason_code, r.verdict.confidence) for r in decided}
    assert got == {str(i): want for i, (*_, want) in enumerate(VERDICTS)}


def test_link_is_idempotent_and_offline(spark):
    table = claims(spark, {}, {}, {"subject": "Apple", "predicate": "turnover"}, {"verified": False})
    none = spark.createDataFrame([], "source_claim_id string, target_claim_id string")
    new = link_sessions(table, none)
    found = new.collect()
    rows = {(r.source_claim_id, r.target_claim_id): r for r in found}
    assert rows["0", "1"].decided_by == "rules" and rows["0", "2"].relationship_type == "UNCERTAIN" and len(rows) == 3
    turned = spark.createDataFrame([(r.target_claim_id, r.source_claim_id) for r in found], "source_claim_id string, target_claim_id string")
    assert link_sessions(table, turned).count() == 0
    assert link_sessions(table.limit(1), none).count() == 0


def test_verification(spark):
    block = "The company said that its total revenue was 394 billion dollars in the year, up from before."
    rows = [("exact", "TOTAL  revenue was 394"), ("near", "its total revenue was 394 billion dolars in the year"), ("none", "total profit is"), ("none", "something else entirely was said here"), ("none", "")]
    df = spark.createDataFrame([(w, q, block) for w, q in rows], "want string, evidence_quote string, block_text string")
    got = verify.verify(df).collect()
    assert len(got) == 5 and all(r.match == r.want for r in got)


def test_best_window_is_exact():
    block = "a b c d e f g h i j".split()
    for quote in ("b c d x", "c d e f", "q q q q q", "a b c"):
        n = len(quote.split())
        want = n >= 4 and any(SequenceMatcher(None, quote, " ".join(block[i : i + n])).ratio() >= 0.92 for i in range(len(block) - n + 1))
        assert best_window(quote, " ".join(block)) == want


def test_batches(spark):
    tiny = spark.createDataFrame([(f"b{i:02}", "d", 1, "x" * (60000 if i == 30 else 5)) for i in range(32)], "id string, document_id string, page int, text string")
    got = {r.id: r.batch_id for r in batching.block_batches(tiny, ["id"]).collect()}
    assert [got[f"b{i:02}"] for i in (0, 19, 20, 29, 30, 31)] == [0, 0, 1, 1, 2, 3]


def test_merge_and_render(spark):
    text = "x" * 50
    rows = [("d", 1, 0.0, y, 9.0, y + 10, t) for y, t in ((0.0, text), (12.0, text), (60.0, text), (75.0, "short"), (200.0, "y" * 5990), (212.0, text))]
    layout = spark.createDataFrame(rows, "document_id string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    got = [len(r.text) for r in batching.merge_blocks(layout).orderBy("seq").collect()]
    assert got == [101, 50, 5990, 50]
    table = spark.createDataFrame([([[" a ", None], ["", " "], ["b", "c"]],)], "t array<array<string>>")
    assert table.select(batching.render_table(F.col("t")).alias("x")).first().x == "a | \nb | c"


def test_ledger_and_stream(spark, tmp_path):
    book = store.Ledger(spark, f"file://{tmp_path}/ledger")
    assert book.read("claims").count() == 0
    table = claims(spark, {}, {}).drop("session_id", "created_at").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    shaped = table.select(*(F.col(f.name).cast(f.dataType) if f.name in table.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CLAIMS.fields))
    shaped.write.parquet(f"{tmp_path}/in/1")
    documents = spark.createDataFrame([("doc0", "s"), ("doc1", "s")], "id string, session_id string")
    stream = spark.readStream.schema(CLAIMS).parquet(f"{tmp_path}/in/*")
    for _ in range(2):
        ingest.start(stream, book, documents, f"{tmp_path}/check", available_now=True).awaitTermination()
    ingest.ingest_batch(book, documents)(shaped, 7)
    assert book.read("claims").count() == 2 and book.read("relationships").count() == 1


def test_labels(spark):
    df = spark.createDataFrame([("failed",), ("parsed",), ("extracted",), ("PENDING",), (None,)], "s string")
    assert [r.x for r in df.select(ledger.status_bucket(F.col("s")).alias("x")).collect()] == ["failed", "processing", "complete", "processing", "complete"]
    kinds = spark.createDataFrame([("CORROBORATES",), ("not_sure",), (None,)], "s string")
    assert [r.x for r in kinds.select(ledger.type_label(F.col("s")).alias("x")).collect()] == ["Corroborates", "Not sure", "Unclassified"]


def test_store_appends_without_rewriting(spark, tmp_path):
    ledger = store.Ledger(spark, f"file://{tmp_path}/ledger")
    row = lambda i: spark.createDataFrame([(str(i), "active")], "id string, status string")
    ledger.append("sessions", row(1))
    ledger.append("sessions", row(2))
    assert sorted(r.id for r in ledger.read("sessions").collect()) == ["1", "2"] and ledger.version("sessions") == 2
    ledger.write("sessions", row(3))
    ledger.append("sessions", row(4))
    assert sorted(r.id for r in ledger.read("sessions").collect()) == ["3", "4"]
    assert sorted(r.id for r in ledger.read("sessions", 2).collect()) == ["1", "2"]
    assert sorted(p.name for p in (tmp_path / "ledger" / "sessions").iterdir()) == ["v1a", "v2a", "v3", "v4a"]


def test_a_batch_is_of_one_session(spark):
    jobs = spark.createDataFrame([("d1", "s1"), ("d2", "s1"), ("d3", "s2")], "document_id string, session_id string")
    assert ingest_plan.one_session(jobs.filter("session_id = 's1'")) == "s1" and ingest_plan.one_session(jobs.limit(0)) is None
    with pytest.raises(ValueError):
        ingest_plan.one_session(jobs)


def test_best_window_equals_brute_force():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(7)
    words = ["net", "sales", "rose", "to", "394", "billion", "in", "fiscal", "2024", "évé"]
    for _ in range(300):
        block = [rng.choice(words) for _ in range(rng.randint(3, 25))]
        at = rng.randrange(len(block))
        quote = [w if rng.random() < 0.9 else w + "s" for w in block[at : at + rng.randint(2, 9)]]
        n, q = len(quote), " ".join(quote)
        want = n >= 4 and any(SequenceMatcher(None, q, " ".join(block[i : i + n])).ratio() >= verify.NEAR for i in range(len(block) - n + 1))
        assert verify.best_window(q, " ".join(block)) == want
        verify.PIECE, whole = 3, verify.PIECE
        assert verify.best_window(q, " ".join(block)) == want
        verify.PIECE = whole
