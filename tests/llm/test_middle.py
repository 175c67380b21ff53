"""Fill-in-middle against plain Python."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa
import pytest

from proofmill.llm import middle as M

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(doc_id, text, rate=100, spm=50, seed=7):
    """n, form, prefix, middle, output."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_query_equals_plain_python(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = M.op13_fill_in_middle(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        *head, output = plain(r.doc_id, texts[r.doc_id])
        assert list(r)[1:] == [*head, sha(output), sha(texts[r.doc_id] or "")]
    assert {r.form for r in rows} >= {"psm", "spm"}


ODD = [(1, None), (2, ""), (3, "\n"), (4, "\n\n\na"), (5, "one line"), (6, "a<P>b\nc\n"), (7, "x\ny<S"), (8, "<\nM>\n"), (9, "z<M>"), (None, "no id\nat all\n"), (11, "é\n日本\r\n 𝒳\x00\n"), (12, ("w" * 99 + "\n") * 30_000), (12, "again\nthe same id"), (12, "again\nthe same id")]


@pytest.mark.parametrize("rate, spm, seed", [(100, 50, 7), (0, 50, 7), (40, 100, 3)])
def test_odd_texts(spark, rate, spm, seed):
    frame = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("doc_id", "text", "'kept' as fim", "7 as h0", "text as r", "3 as `a.b`")
    made = M.fill_in_middle(frame, rate, spm, seed)
    assert made.columns == ["doc_id", "fim", "h0", "r", "a.b", "fim"]
    rows = made.toDF("doc_id", "old", "h0", "r", "ab", "fim").collect()
    key = lambda x: (x[0] or 0, len(x[1] or ""))
    assert all(r.old == "kept" and r.h0 == 7 and r.ab == 3 for r in rows)
    assert sorted((tuple([r.doc_id, r.r, *r.fim]) for r in rows), key=key) == sorted(((i, t, *plain(i, t, rate, spm, seed)) for i, t in ODD), key=key)
    assert M.fill_in_middle(frame.limit(0)).count() == 0


def test_what_is_restored(spark):
    made = M.fill_in_middle(spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "coalesce(text, '') as was")).select("was", "fim.*")
    assert made.filter(M.restored(made.output, made.form) != made.was).count() == 0


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab\n<PSM>é", max_size=30)), min_size=1, max_size=20), st.integers(0, 10**6))
@settings(max_examples=200, deadline=None)
def test_batches(texts, base):
    ids = list(range(base, base + len(texts)))
    digests = [sha(f"7:{i}") for i in ids]
    drawn = [np.array([int(d[8 * i : 8 * i + 8], 16) for d in digests]) for i in range(4)]
    columns = [c.to_pylist() for c in M.transform(pa.array(texts, pa.string()), drawn)]
    assert list(zip(*columns, strict=True)) == [plain(i, t) for i, t in zip(ids, texts, strict=True)]
