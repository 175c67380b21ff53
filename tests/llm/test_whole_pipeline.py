"""The pipeline: stages against planted cases and brute force, clashing columns, empty tables, recurring ids."""

import random
import re

import corpus_pipeline


def test_recurring_ids_lose_no_clean_rows(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    a, b, c = text(), text(), text()
    rows = [(3, a, "s"), (7, near(a), "s"), (7, text(), "s"), (5, b, "s"), (9, near(b), "s"), (5, a + " more", "s")]
    rows += [(20, text(), "s"), (20, text(), "s"), (20, "", "s"), (20, None, "s"), (20, None, "s"), (30, c, "s"), (30, c, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.jaccard_dedup(spark, docs, "")
    assert got.columns == docs.columns
    gone = (rows[1], rows[4], rows[5], rows[12])
    want = list(rows)
    for row in gone:
        want.remove(row)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EXTRA = ["tox", "leak", "pii", "_row", "_rest", "root"]


def _tables(spark, folder):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 7))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(14)
    rows = [(i, text(30) + (" you grumblesnork now " if i % 5 == 0 else " ") + text(20)) for i in range(200)]
    rows += [(300, rows[1][1]), (301, rows[2][1] + " end"), (302, text(20) + " " + item + " " + text(5)), (303, "Mail joe.doe@example.com or call, " + text(30)), (304, None), (305, ""), (306, None), (307, text(6000)), (308, text(40)), (308, text(40))]
    rows.append(rows[3])
    more = [[1], "x", 2, 3.0, True, "r"]
    docs = spark.createDataFrame([(i, t, len(t or ""), *more) for i, t in rows], "doc_id long, text string, n_chars long, tox array<int>, leak string, pii long, _row double, _rest boolean, root string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, item


def test_stages_on_planted_cases(spark, tmp_path):
    rows, item = _tables(spark, f"file://{tmp_path}/in")
    folder = f"file://{tmp_path}/in"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, folder)
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) if name != "packing" else None
        if name != "packing":
            assert {tuple(r[c] if c != "tox" else tuple(r[c]) for c in EXTRA) for r in kept.collect()} == {((1,), "x", 2, 3.0, True, "r")}
    clean = [r for r in rows if not (r[0] < 200 and r[0] % 5 == 0)]
    assert steps["toxicity"] == sorted(clean, key=str)
    # brute force: of each component one row stays
    one = list(clean)
    for gone in (rows[200], rows[201], rows[3]):
        one.remove(gone)
    assert steps["jaccard_join"] == sorted(one, key=str)
    window = [WORD.findall(item)[k : k + 10] for k in range(5)]
    has = lambda t: any(WORD.findall(t or "")[k : k + 10] in window for k in range(len(WORD.findall(t or ""))))
    assert steps["decontamination"] == sorted([r for r in one if not has(r[1])], key=str) and len(one) - len(steps["decontamination"]) == 1
    changed = [(a, b) for a, b in zip(steps["decontamination"], steps["pii"], strict=True) if a != b]
    assert [a[0] for a, _ in changed] == [303] and "joe.doe" not in changed[0][1][1]
    whole = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert sorted({d for d, _ in whole}) == sorted({d for d, _ in steps["pii"]})
    for (_, n), parts in whole.items():
        at = 0
        for start, length in sorted(set(parts)):
            assert start == at
            at += length
        assert at == n


def test_empty_tables(spark, tmp_path):
    _tables(spark, f"file://{tmp_path}/full")
    folder = f"file://{tmp_path}/none"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"file://{tmp_path}/full/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
