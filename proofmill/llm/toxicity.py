"""Toxicity by Levenshtein automata over a learned lexicon.

The lexicon is learned from labelled documents: words, and stems of four to seven
letters, whose documents are toxic far more often than chance explains. Stems
match every word that begins with them. The terms form a trie; the Levenshtein
automaton of up to one edit (terms of five letters or more) is intersected with
it state by state as words are read, and states are remembered, so that a word is
matched in one pass. A near word that clean training documents use is no match.

Around each match a window of words tells quotation (quote marks, reporting verbs)
from abuse (second person, no such marks). A logistic model over the counts of
exact and near matches, quoted or not, and their density gives the score.

At most ``TRAIN`` labelled rows, drawn by a hash of their ids, train the model.
Rows whose crc32(doc_id as text) mod 4 is 2 are never among them. Null texts are
empty; empty texts get the score of no match. Repeated rows are scored each.
Columns of documents pass by; a column named ``tox`` is replaced. Without toxic or
without clean labelled rows the lexicon is empty and the score is 0 for all.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.llm import memo
from proofmill.llm.shared import table, written
from proofmill.llm.vec import slices

TRAIN = 20_000
EVIDENCE = 4.5  # natural log of the likelihood ratio that a term needs, beyond the log of the number of terms tried for each that is taken
THRESHOLD = 0.3
AROUND = 6
STEMS = (4, 5, 6, 7)
KEEP = 200_000
WORD = re.compile(r"\w[\w*@$]*\w|\w")
QUOTES = "\"“”„«»‟"
#: Reporting verbs and second-person words in the four languages.
REPORTING = frozenset("said says wrote writes quoted quote called asked replied reported sagte schrieb zitierte nannte dit écrit cité dijo escribió citó".split())
SECOND_PERSON = frozenset("you your yours youre du dich dein ihr euch tu toi vous votre ton tú usted te tus".split())
FEATURES = ("exact_abuse", "exact_quoted", "near_abuse", "near_quoted", "density", "addressed")
TOX = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_exact", T.IntegerType()), T.StructField("n_near", T.IntegerType()), T.StructField("n_quoted", T.IntegerType())])
_ARROW_TOX = pa.struct([("score", pa.float64()), ("n_exact", pa.int32()), ("n_near", pa.int32()), ("n_quoted", pa.int32())])


class LexiconAutomaton:
    """The trie of terms intersected with the automaton of at most one edit; its states are made when first met."""

    def __init__(self, terms: list[str], clean: frozenset = frozenset()):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]  # "word", "stem"
        self.depth = [0]
        self.clean = clean
        for term in terms:
            at = 0
            for c in term.rstrip("*"):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.depth.append(self.depth[at] + 1)
                at = self.children[at][c]
            self.ends[at] = "stem" if term.endswith("*") or self.ends[at] == "stem" else "word"
        self.states: list[frozenset] = []
        self.names: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.verdicts: list[str | None] = []
        self.start = self._state({(0, 0)}) if terms else -1
        self.memo: dict[str, str | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def _state(self, items: set) -> int:
        """Close under skipped trie letters and number the set; -1 if none is left."""
        todo = list(items)
        while todo:
            node, e = todo.pop()
            if node >= 0 and e == 0:
                for child in self.children[node].values():
                    if (child, 1) not in items:
                        items.add((child, 1))
                        todo.append((child, 1))
        items = {(n, e) for n, e in items if not (e and (n, 0) in items)}
        if not items:
            return -1
        key = frozenset(items)
        if key not in self.names:
            self.names[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.verdicts.append(self._verdict(key))
        return self.names[key]

    def _verdict(self, items: frozenset) -> str | None:
        best = None
        for node, e in items:
            if node == -1 or (e == 0 and self.ends[node] == "word"):
                return "exact"
            if node >= 0 and e == 1 and self.ends[node] == "word" and self.depth[node] >= 5:
                best = "near"
        return best

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.states[state]:
            if node == -1:
                out.add((-1, 0))
                continue
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, e))
                if e == 0 and self.ends[child] == "stem":
                    out.add((-1, 0))
            if e == 0:
                out.add((node, 1))
                out.update((x, 1) for x in self.children[node].values())
        return self._state(out)

    def match(self, word: str) -> str | None:
        """exact, near or None."""
        if word in self.memo:
            return self.memo[word]
        state = self.start
        for c in word:
            if state < 0:
                break
            step = self.steps[state].get(c)
            if step is None:
                step = self.steps[state][c] = self._step(state, c)
            state = step
        found = self.verdicts[state] if state >= 0 else None
        if found == "near" and word in self.clean:
            found = None
        if len(self.memo) >= KEEP:
            self.memo.clear()
        self.memo[word] = found
        return found


def matches(automaton: LexiconAutomaton, text: str) -> tuple[list[tuple[str, str, bool, bool]], int]:
    """(word, exact or near, quoted, addressed to the reader) of each match, and the number of words."""
    text = text.lower()
    words = WORD.findall(text)
    memo = automaton.memo
    found = []
    for i, w in enumerate(words):
        kind = memo[w] if w in memo else automaton.match(w)
        if kind:
            found.append((i, w, kind))
    if not found:
        return [], len(words)
    spans = [m.span() for m in WORD.finditer(text)]
    out = []
    for i, w, kind in found:
        near = words[max(0, i - AROUND) : i + AROUND + 1]
        before = text[spans[max(0, i - AROUND)][0] : spans[i][0]]
        after = text[spans[i][1] : spans[min(len(words) - 1, i + AROUND)][1]]
        quoted = (any(q in before for q in QUOTES) and any(q in after for q in QUOTES)) or not REPORTING.isdisjoint(near)
        out.append((w, kind, quoted, not SECOND_PERSON.isdisjoint(near)))
    return out, len(words)


def features(found: list, n_words: int) -> list[float]:
    count = Counter((kind, quoted) for _, kind, quoted, _ in found)
    weight = sum((1.0 if kind == "exact" else 0.5) * (0.5 if quoted else 1.0) for _, kind, quoted, _ in found)
    return [
        math.log1p(count["exact", False]),
        math.log1p(count["exact", True]),
        math.log1p(count["near", False]),
        math.log1p(count["near", True]),
        min(1.0, 20 * weight / max(20, n_words)),
        float(any(you for *_, you in found)),
    ]


def _terms(seen: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """Terms with strong evidence: stems that say more than their words, and words; of a stem's words those that an edit may reach."""
    base = n_toxic / (n_toxic + n_clean)
    t, c = F.col("toxic"), F.col("clean")
    p = (t + 0.5) / (t + c + 1)
    evidence = t * F.log(p / base) + c * F.log((1 - p) / (1 - base))
    tried = seen.filter(t >= 3)
    # as many terms as may stand together: the k-th best needs the evidence of one chance in e**EVIDENCE * tried / k
    needs = EVIDENCE + math.log(max(1, tried.count()))
    strong = tried.filter(p > 0.8).withColumn("evidence", evidence).filter(F.col("evidence") >= EVIDENCE)
    rows = sorted(strong.select("term", "toxic", "evidence").collect(), key=lambda r: (-r.evidence, r.term))  # terms of three or more of the sampled documents
    enough = max((k for k, r in enumerate(rows, 1) if r.evidence >= needs - math.log(k)), default=0)
    rows = rows[:enough]
    out: list[str] = []
    stems: set[str] = set()
    best_word = {r.term: r.toxic for r in rows if not r.term.endswith("*")}
    for r in sorted(rows, key=lambda r: (not r.term.endswith("*"), len(r.term), r.term)):
        bare = r.term.rstrip("*")
        if any(bare[:k] in stems for k in STEMS) and (r.term.endswith("*") or len(bare) < 5):
            continue
        if r.term.endswith("*"):
            # a stem says more than its words only if no single word makes most of it
            if 2 * max((n for w, n in best_word.items() if w.startswith(bare)), default=0) > r.toxic:
                continue
            stems.add(bare)
        out.append(r.term)
    return out


def _count_terms(train: DataFrame, only: frozenset | None) -> DataFrame:
    """term, toxic, clean: training documents of either label with the term."""
    shared = train.sparkSession.sparkContext.broadcast(only)

    @memo.task()
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value
        n = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen = {w for w in WORD.findall((text or "").lower()) if 2 < len(w) < 40}
                seen |= {w[:k] + "*" for w in seen for k in STEMS if len(w) > k}
                n[toxic].update(seen if keep is None else seen & keep)
        terms = list(n[0].keys() | n[1].keys())
        yield pa.record_batch({"term": pa.array(terms, pa.string()), "toxic": pa.array([n[1][t] for t in terms], pa.int64()), "clean": pa.array([n[0][t] for t in terms], pa.int64())})

    return train.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class ToxicModel:
    def __init__(self, automaton: LexiconAutomaton, weights: np.ndarray | None):
        self.automaton, self.weights = automaton, weights

    def score(self, found: list, n_words: int) -> float:
        if self.weights is None:
            return 0.0
        z = self.weights[0] + float(np.dot(self.weights[1:], features(found, n_words)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN) -> ToxicModel:
    """Fit on at most ``rows`` labelled documents that aren't held out."""
    usable = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1)).filter(~held_out()).dropDuplicates(["doc_id"])
    drawn = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # copies would count one accident many times: one document of each label and family stays; a family has the two least shingles in common
    drawn = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").withColumn("words", F.split(F.lower("text"), r"[\s.,;:!?]+"))
    shingles = F.transform(F.sequence(F.lit(1), F.size("words") - 4), lambda i: F.xxhash64(F.slice("words", i, 5)))
    family = F.when(F.size("words") > 5, F.slice(F.array_sort(F.array_distinct(shingles)), 1, 2)).otherwise(F.array(F.xxhash64("text")))
    sample = written(drawn.select("text", "toxic", family.alias("family")).dropDuplicates(["toxic", "family"]).select("text", "toxic"), "tox-train")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return ToxicModel(LexiconAutomaton([]), None)
    frequent = _count_terms(sample.filter("toxic = 1"), None).filter("toxic >= 3")
    candidates = frozenset(r.term for r in frequent.select("term").collect())
    terms = _terms(_count_terms(sample, candidates), n[1], n[0])
    automaton = LexiconAutomaton(terms)
    spark = docs.sparkSession

    def look(shared, mode: str):

        @memo.task()
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                near, rows, toxic = {0: Counter(), 1: Counter()}, [], batch.column("toxic").to_pylist()
                for text, label in zip(batch.column("text").to_pylist(), toxic, strict=True):
                    found, n_words = matches(automaton, text or "")
                    near[label].update({w for w, kind, *_ in found if kind == "near"})
                    rows.append(features(found, n_words))
                if mode == "near":
                    ws = list(near[0].keys() | near[1].keys())
                    yield pa.record_batch({"word": pa.array(ws, pa.string()), "toxic": pa.array([near[1][w] for w in ws], pa.int64()), "clean": pa.array([near[0][w] for w in ws], pa.int64())})
                else:
                    yield pa.record_batch({"x": pa.array(rows, pa.list_(pa.float64())), "y": pa.array(toxic, pa.int32())})

        return run

    near = sample.select("text", "toxic").mapInArrow(look(spark.sparkContext.broadcast(automaton), "near"), "word string, toxic long, clean long")
    plain = near.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("clean > 0 and clean >= toxic")
    automaton = LexiconAutomaton(terms, frozenset(r.word for r in plain.collect()))
    points = sample.select("text", "toxic").mapInArrow(look(spark.sparkContext.broadcast(automaton), "features"), "x array<double>, y int").collect()
    x, y = np.array([r.x for r in points]), np.array([r.y for r in points], float)
    return ToxicModel(automaton, _logistic(x, y))


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """Documents with ``tox``: score, n_exact, n_near, n_quoted."""
    docs = docs.drop("tox")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @memo.task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                out = []
                for text in part.column("text").to_pylist():
                    found, n_words = matches(model.automaton, text or "")
                    kinds = Counter(kind for _, kind, *_ in found)
                    out.append({"score": model.score(found, n_words), "n_exact": kinds["exact"], "n_near": kinds["near"], "n_quoted": sum(q for _, _, q, _ in found)})
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(out, _ARROW_TOX)], names=[*names, "tox"])
        model.automaton.memo.clear()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("tox", TOX)]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "tox.score", (F.col("tox.score") >= THRESHOLD).cast("int").alias("predicted"), "tox.n_exact", "tox.n_near", "tox.n_quoted")
