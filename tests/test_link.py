"""Linking where ids are keys, and pairs that the rules leave open."""

import random

from pyspark.sql import functions as F
from test_operators import claims

from proofmill import catalogue
from proofmill.operators import candidates, pairs, verdict
from proofmill.plans import link
from proofmill.plans.link import link_sessions
from proofmill.sources import claims as src

SF = "/root/testdata/sf0.001"


def test_distinct_ids_need_no_choice(spark):
    claims = src.claims(spark, SF)
    some = pairs.ordered(claims.filter("verified"))
    stored = verdict.ruled(some).filter("verdict.relationship_type = 'CORROBORATES'").selectExpr("b.id source_claim_id", "a.id target_claim_id")
    links = lambda **how: sorted(map(str, link_sessions(claims, stored, **how).drop("created_at").collect()))
    found = links(distinct_ids=True)
    assert found and found == links()
    seen = {frozenset(r) for r in stored.collect()}
    assert seen and not any(frozenset((r.source_claim_id, r.target_claim_id)) in seen for r in link_sessions(claims, stored, distinct_ids=True).collect())


def test_open_pairs_are_those_that_no_rule_decides(spark):
    some = pairs.ordered(src.claims(spark, SF).filter("verified"))
    want = verdict.partition(verdict.decide(pairs.enumerate_pairs(verdict.prepared(some))))[1].selectExpr("session_id", "a.ord", "b.ord").collect()
    assert sorted(map(tuple, verdict.left_open(some).select("session_id", "ord_a", "ord_b").collect())) == sorted(map(tuple, want))


def test_known_pairs_reach_their_blocks(spark, monkeypatch):
    """Small blocks and parts give the links of whole sessions, stored pairs of either direction left out."""
    claims = src.claims(spark, SF)
    some = pairs.ordered(claims.filter("verified"))
    stored = verdict.ruled(some).selectExpr("b.id source_claim_id", "a.id target_claim_id").filter("crc32(source_claim_id) % 3 = 0")
    links = lambda: sorted(map(str, link_sessions(claims, stored, distinct_ids=True).drop("created_at").collect()))
    found = links()
    monkeypatch.setattr(candidates, "BLOCK", 7)
    monkeypatch.setattr(verdict, "PART", 3)
    assert found and found == links()


def test_blocks_of_a_session_meet_in_several_tasks(spark, monkeypatch):
    """Few bytes of claims are many pairs, so their groups aren't put together by bytes."""
    monkeypatch.setattr(candidates, "BLOCK", 20)
    claims = pairs.ordered(src.claims(spark, SF).filter("verified").withColumn("session_id", F.lit("S")))
    assert candidates.find(claims).select(F.spark_partition_id()).distinct().count() > 1
    assert verdict.ruled(claims).select(F.spark_partition_id()).distinct().count() > 1


def test_upload_makes_blocks_and_claims_once(spark):
    """Links read the upload's claims from a working table, and no pair is shuffled to be told from others."""
    links = catalogue.ingest_links(spark, SF)
    assert {f.rsplit("/", 2)[-2].split("-")[0] for f in links.inputFiles()} == {"claims"}
    assert " AS rn#" not in links._jdf.queryExecution().optimizedPlan().toString()
    assert links.count() == links.distinct().count()


def test_links_of_kinds_equal_all_pairs(spark, monkeypatch):
    """Repeated claims, null and repeated ids and documents, stored pairs of either direction: the links of all pairs, one by one."""
    rng = random.Random(4)
    rows = []
    for k in range(150):
        year, d = rng.choice([2021, 2022, None]), rng.choice("ABC")
        rows.append({"id": rng.choice([f"c{k}"] * 20 + [None, "c0"]), "document_id": rng.choice([d, d, d, "", None]), "session_id": rng.choice("ST"), "subject": rng.choice(["Apple", "apple ", "Tesla Motors", "Alpine", None]),
            "predicate": rng.choice(["revenue", "net sales", "headcount"]), "value": rng.choice([1.0, 2.0, 2.01, -0.0, 0.0, None]), "unit": rng.choice(["million USD", "$ mn", "percent"]),
            "period_start": year and f"{year}-01-01", "period_end": year and f"{year}-12-31", "scope": rng.choice([None, None, "Domestic"])})
    table = claims(spark, *rows).cache()
    some = pairs.ordered(table).cache()
    decided = verdict.decide(pairs.enumerate_pairs(verdict.prepared(some))).select("session_id", "a.ord", "b.ord", "a.id", "b.id", "verdict").toDF("session_id", "o", "p", "x", "y", "verdict")
    scores = pairs.pair_scores(pairs.enumerate_pairs(pairs.prepared(some))).filter("score > 0").selectExpr("session_id", "a.ord o", "b.ord p")
    want = decided.join(scores, ["session_id", "o", "p"]).cache()
    # stored pairs in both directions, some of two claims of one kind
    stored = want.filter("x is not null and y is not null and crc32(concat(x, y)) % 5 < 2").selectExpr("if(o % 2 = 0, x, y) source_claim_id", "if(o % 2 = 0, y, x) target_claim_id").cache()
    seen = {(min(r), max(r)) for r in stored.collect()}
    known = {(r.session_id, r.o, r.p, r.x, r.y, r.verdict) for r in want.collect() if r.x is None or r.y is None or (min(r.x, r.y), max(r.x, r.y)) not in seen}
    assert len(seen) > 500 and len(known) > 1000 and len({r[5] and r[5].reason_code for r in known}) > 3
    for many, least, block, part in ((512, 4, 1024, 512), (3, 4, 7, 2), (1, 1, 16, 512)):
        monkeypatch.setattr(candidates, "MANY", many)
        monkeypatch.setattr(candidates, "LEAST", least)
        monkeypatch.setattr(candidates, "BLOCK", block)
        monkeypatch.setattr(verdict, "PART", part)
        got = candidates.expanded(link.answered_candidates(some, stored)).collect()
        assert len(got) == len(known) and set(map(tuple, got)) == known


def test_equal_claims_leave_python_as_one_row(spark):
    """All pairs of three kinds of claims are candidates; only their members leave the task that finds them."""
    rows = [{"id": f"c{k}", "document_id": f"d{k}", "session_id": "S", "subject": f"subject {k % 3}", "predicate": "mentions", "value": float(k % 2)} for k in range(600)]
    some = pairs.ordered(claims(spark, *rows))
    found = link.answered_candidates(some, spark.createDataFrame([], "source_claim_id string, target_claim_id string"))
    assert found.count() == 36 and candidates.expanded(found).count() == 600 * 599 // 2
