"""Statistics from changes against a full count, after random batches and deletes."""

import random

from pyspark.sql import functions as F

from proofmill.operators import ledger as reads
from proofmill.operators import statistics as S
from proofmill.operators.store import Ledger


def rows(df):
    return sorted((tuple(str(v) for v in r) for r in df.select("session_id", "documents", "verified_claims", "unverified_claims", "relationships", F.map_entries("relationships_by_type")).collect()))


def test_changes_equal_a_full_count(spark, tmp_path):
    rng = random.Random(6)
    book = Ledger(spark, f"file://{tmp_path}/ledger")
    book.append("sessions", spark.createDataFrame([(f"s{k}", "active") for k in range(4)], "id string, status string"))
    docs, claims, registry = [], [], {}

    def full():
        return reads.session_stats(book.read("sessions"), book.read("documents"), book.read("claims"), book.read("relationships"))

    assert not S.refresh(book) and rows(S.session_stats(book)) == rows(full())
    for step in range(5):
        new = [(f"d{step}-{k}", f"s{rng.randrange(3)}") for k in range(3)]
        own = [(f"c{step}-{k}", rng.choice(new)[0], rng.random() < 0.7, rng.choice("pqrst"), str(step)) for k in range(8)]
        docs, claims = docs + new, claims + own
        book.append("documents", spark.createDataFrame(new, "id string, session_id string"))
        book.append("claims", spark.createDataFrame(own, "id string, document_id string, verified boolean, predicate string, definition string"))
        session = dict(docs)
        pairs = [(a[0], b[0]) for a in claims for b in claims if a[0] < b[0] and session[a[1]] == session[b[1]]]
        book.append("relationships", spark.createDataFrame([(f"r{step}-{k}", *rng.choice(pairs), rng.choice(["CORROBORATES", "RECONCILES"])) for k in range(6)], "id string, source_claim_id string, target_claim_id string, relationship_type string"))
        if step % 2:
            gone = rng.choice(docs)[0]
            book.delete_documents(spark.createDataFrame([(gone,)], "id string"))
            docs, claims = [d for d in docs if d[0] != gone], [c for c in claims if c[1] != gone]
        if step == 3:
            assert book.compact("claims", versions=2)
        if step != 1:  # two steps at once, too
            assert S.refresh(book) and not S.refresh(book)
            assert rows(S.session_stats(book)) == rows(full())
        for c in own:
            registry.setdefault(c[3], c[4])
    known = book.read("predicate_registry").collect()
    assert {r.predicate: r.example_definition for r in known} == registry and len(known) == len(registry)
