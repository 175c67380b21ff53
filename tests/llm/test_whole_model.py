"""The perplexity model keeps every 4-gram, by broadcast and by join, and serves each language."""

import math
import random

from proofmill.llm import perplexity


def _documents(n):
    rng = random.Random(11)
    text = lambda start: "".join(chr(start + rng.randrange(60)) for _ in range(rng.randint(0, 90)))
    rows = [(i, text((0x61, 0x430, 0x4E00)[i % 3]), ("en", None, "zh")[i % 3]) for i in range(n)]
    return [*rows, (0, "abcd abcd", "en"), (0, "abcd abcd", "en"), (n, None, "en"), (n + 1, "abcdef", "xx")]


def test_join_equals_broadcast(spark):
    docs = spark.createDataFrame(_documents(60), "doc_id long, text string, lang string")
    model = perplexity.fit(docs.filter("doc_id < 30"))
    assert not hasattr(perplexity, "MOST") and sorted(model.langs) == ["", "en", "zh"]

    def rows(held):
        got = [(r.doc_id, r.lang, r.n_words, r.word_chars, None if r.log_perplexity is None else round(r.log_perplexity, 9)) for r in perplexity.measure(docs, model, held).collect()]
        return sorted(got, key=str)

    assert rows(0) == rows(1 << 30) and len(rows(0)) == docs.count()
    assert {r[1] for r in rows(0) if r[-1] is not None} == {"", "en", "zh"}


def test_probabilities_sum_to_one(spark):
    """After a seen context, those of all characters and of one that the language never has."""
    docs = spark.createDataFrame([(1, "abcabdabcabeabcabd", "en")], "doc_id long, text string, lang string")
    model = perplexity.fit(docs)
    key = lambda s: sum(ord(c) << 16 * (3 - i) for i, c in enumerate(s))
    keys = [("en", key("cab" + c)) for c in "abcdez"]
    got = [r.logp for r in model.scored(spark.createDataFrame(keys, "lang string, gram long")).collect()]
    assert len(got) == 6 and abs(sum(map(math.exp, got)) - 1) < 1e-9


def test_language_without_good_documents_uses_all_of_its_own(spark):
    docs = spark.createDataFrame([(1, "good text", "en"), (2, "other text", "en"), (3, "guter Text", "de"), (4, "texte", None), (5, "abc", "fr"), (6, "un texte", "fr")], "doc_id long, text string, lang string")
    good = spark.createDataFrame([(1,), (5,)], "doc_id long")
    assert sorted({r.doc_id for r in perplexity.reference_of(docs, good).collect()}) == [1, 3, 4, 5, 6]
