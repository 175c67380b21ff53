"""Versions, deletes without rewriting, concurrent writers, buckets."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from proofmill.operators.store import Conflict, Ledger
from proofmill.streaming import ingest

ROW = "id string, status string"


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.startswith("part-")}


def test_concurrent_appends_lose_nothing(spark, tmp_path):
    book = Ledger(spark, f"file://{tmp_path}/ledger")
    add = lambda k: book.append("sessions", spark.createDataFrame([(str(k), "active")], ROW).coalesce(1))
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(add, range(100)))
    assert sorted(numbers) == list(range(1, 101))
    assert {r.id for r in book.read("sessions").collect()} == {str(k) for k in range(100)}
    assert book.compact("sessions") and not book.compact("sessions")
    assert book.version("sessions") == 101 and book.read("sessions").count() == 100
    assert book.read("sessions").select("id").inputFiles()[0].rsplit("/", 2)[-2] == "v101"
    assert book.read("sessions", 50).count() == 50
    book.forget("sessions", 101)
    assert os.listdir(tmp_path / "ledger" / "sessions") == ["v101"]


def test_a_replacement_fails_after_another_change(spark, tmp_path):
    book = Ledger(spark, f"file://{tmp_path}/ledger")
    row = lambda k: spark.createDataFrame([(k, "active")], ROW)
    seen = book.append("sessions", row("1"))
    book.append("sessions", row("2"))
    with pytest.raises(Conflict):
        book.write("sessions", row("3"), expected=seen)
    assert {r.id for r in book.read("sessions").collect()} == {"1", "2"} and not os.listdir(tmp_path / "ledger" / "_aside")


def filled(spark, book):
    docs = [(f"d{k}", f"s{k % 2}") for k in range(4)]
    book.append("sessions", spark.createDataFrame([("s0", "active"), ("s1", "active")], ROW))
    book.append("documents", spark.createDataFrame(docs, "id string, session_id string"))
    book.append("evidence_blocks", spark.createDataFrame([(f"b{k}", f"d{k % 4}") for k in range(8)], "id string, document_id string"))
    book.append("claims", spark.createDataFrame([(f"c{k}", f"d{k % 4}") for k in range(12)], "id string, document_id string"))
    book.append("relationships", spark.createDataFrame([(f"r{k}", f"c{k}", f"c{k + 2}") for k in range(10)], "id string, source_claim_id string, target_claim_id string"))


def test_deletes_rewrite_no_file(spark, tmp_path):
    book = Ledger(spark, f"file://{tmp_path}/ledger")
    filled(spark, book)
    before = files(tmp_path)
    book.delete_documents(spark.createDataFrame([("d1",), ("nothing",), (None,)], "id string"))
    after = files(tmp_path)
    assert before.items() <= after.items()
    ids = lambda name, v=None: {r.id for r in book.read(name, v).collect()}
    assert ids("documents") == {"d0", "d2", "d3"} and ids("claims") == {f"c{k}" for k in range(12) if k % 4 != 1}
    assert ids("evidence_blocks") == {f"b{k}" for k in range(8) if k % 4 != 1}
    assert ids("relationships") == {f"r{k}" for k in range(10) if k % 4 != 1 and (k + 2) % 4 != 1}
    assert ids("claims", 1) == {f"c{k}" for k in range(12)}
    # what is added after a delete stays, with an id that was deleted, too
    book.append("claims", spark.createDataFrame([("c1", "d1")], "id string, document_id string"))
    assert "c1" in ids("claims") and "c5" not in ids("claims")
    assert book.compact("claims", versions=1)
    assert ids("claims") == {f"c{k}" for k in range(12) if k % 4 != 1} | {"c1"}
    book.delete_session("s0")
    assert ids("sessions") == {"s1"} and ids("documents") == {"d3"} and ids("claims") == {"c1", "c3", "c7", "c11"}


def test_a_reader_of_a_bucket_opens_no_other(spark, tmp_path):
    book = Ledger(spark, f"file://{tmp_path}/ledger")
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("status"), (F.col("id") % 4).cast("int").alias("k"))
    book.append("sessions", rows, "k")
    book.append("sessions", rows.filter("id < 10"), "k")
    book.append("sessions", spark.createDataFrame([("loose", "x")], ROW))
    some = book.read("sessions", buckets={1, 9})
    assert sorted(r.id for r in some.collect()) == sorted([str(k) for k in range(1, 100, 4)] + ["1", "5", "9", "loose"])
    assert {f.rsplit("/", 2)[-2] for f in some.inputFiles()} == {"_b=1", "v3a"}
    book.delete("sessions", "id", spark.createDataFrame([("5",)], "id string"))
    assert "5" not in {r.id for r in book.read("sessions", buckets={1}).collect()} and book.read("sessions").count() == 109
    assert book.read("sessions", buckets={7}).count() == 1
    assert book.compact("sessions", versions=1) and book.read("sessions").count() == 109
    some = book.read("sessions", buckets={1})
    assert some.count() == 27 and {f.rsplit("/", 2)[-2] for f in some.inputFiles()} == {"_b=1", "_b=__HIVE_DEFAULT_PARTITION__"}


def test_batches_read_their_buckets(spark, tmp_path, monkeypatch):
    """Two sessions in different buckets; the second batch doesn't open the first one's files."""
    book = Ledger(spark, f"file://{tmp_path}/ledger")
    documents = spark.createDataFrame([("d0", "s0"), ("d1", "s0"), ("e0", "s1"), ("e1", "s1")], "id string, session_id string")
    claim = lambda i, d: (i, d, "Apple", "revenue", 1.0, "usd", True)
    schema = "id string, document_id string, subject string, predicate string, value double, unit string, verified boolean"
    full = lambda rows: book._shaped("claims", spark.createDataFrame(rows, schema))
    run = ingest.ingest_batch(book, documents)
    run(full([claim("1", "d0"), claim("2", "d1"), claim("9", "unknown")]), 0)
    opened = []
    whole = Ledger.read
    monkeypatch.setattr(Ledger, "read", lambda self, name, version=None, buckets=None: opened.append(df := whole(self, name, version, buckets)) or df)
    run(full([claim("3", "e0"), claim("4", "e1"), claim("9", "unknown"), claim("3", "e0")]), 1)
    first = {r.b for r in documents.filter("session_id = 's0'").select(ingest.bucket_of(F.col("session_id")).alias("b")).collect()}
    assert not [f for df in opened for f in df.inputFiles() if f.rsplit("/", 2)[-2] in {f"_b={b}" for b in first}]
    monkeypatch.undo()
    assert sorted(r.id for r in book.read("claims").collect()) == ["1", "2", "3", "4", "9"] and book.read("relationships").count() == 2
    run(full([claim("3", "e0")]), 2)
    assert book.read("claims").count() == 5 and book.read("relationships").count() == 2
