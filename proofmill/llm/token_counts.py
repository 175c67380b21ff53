"""Token counts by heap-and-linked-list byte-pair merging, without making ids.

A segment's symbols stand in a doubly linked list; a heap gives the adjacent pair
of lowest rank (leftmost first), which is merged, and the new neighbours are
pushed. The count is the initial symbols minus the merges; symbols outside the
vocabulary count one token per UTF-8 byte. Merges can't cross the start of a
word mark or a symbol outside the vocabulary, so texts are cut there and the
counts of recurring segments are kept in a bounded table.

The vocabulary is the piece file of a sentencepiece BPE model; only its pieces
and scores are read. Null and empty texts have no tokens; repeated rows are counted each.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import memo
from proofmill.llm.shared import table
from proofmill.llm.vec import slices

MARK = "▁"
LIMIT = 4096
LONGEST = 64
KEEP = 400_000


class MergeCounter:
    def __init__(self, path: str, keep: int = KEEP):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("pieces that hold a word mark inside can't be counted word by word")
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.known = memo.Recent(keep)
        # sentencepiece's own normalizer maps the text first, as the model file says
        self.normalize = sentencepiece.SentencePieceNormalizer(model_file=path).Normalize
        self.identity = self.normalize("a  bÉ́ ") in (MARK + "a" + 2 * MARK + "bÉ́" + MARK, "a  bÉ́ ", " a  bÉ́ ")

    def merged(self, segment: str) -> int:
        """Tokens of one segment."""
        rank, n = self.rank, len(segment)
        symbols = list(segment)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := segment[i : i + 2]) in rank]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j < 0 or symbols[i] + symbols[j] != piece:
                continue
            symbols[i], symbols[j] = piece, None
            merges += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (p := piece + symbols[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if (h := before[i]) >= 0 and (p := symbols[h] + piece) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        unknown = sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in rank)
        return n - merges + unknown

    def cut(self, word: str) -> list[str]:
        """Parts of a word between which no piece of the vocabulary reaches."""
        if len(word) < 2:
            return [word]
        parts, at = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.pairs:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        return parts

    def word(self, word: str) -> int:
        return sum(map(self.merged, self.cut(MARK + word)))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.identity:
            text = self.normalize(text).removeprefix(MARK).replace(MARK, " ")
        if MARK in text:  # a literal mark reads as a space
            text = text.replace(MARK, " ")
        total, known = 0, self.known.new
        if "  " in text or text[0] == " " or text[-1] == " ":
            return self._spaced(text)
        words = text.split(" ")
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        aged = self.known.get
        for w in words:
            n = known.get(w)
            if n is None:
                n = aged(w)
            if n is None:
                n = self.word(w)
                if len(w) <= LONGEST:
                    known[w] = n
            total += n
        self.known.turn()
        return total

    def _spaced(self, text: str) -> int:
        """Texts with runs of spaces: runs of marks join the word after them."""
        total, marks = 0, 0
        text = " " + text
        at, n = 0, len(text)
        while at < n:
            marks = at
            while at < n and text[at] == " ":
                at += 1
            begin = at
            while at < n and text[at] != " ":
                at += 1
            total += sum(map(self.merged, self.cut(MARK * (begin - marks) + text[begin:at])))
        return total


_counters: dict[str, MergeCounter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""

    @memo.task("counts")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo.keeps("counts", _counters.clear)
        if path not in _counters:
            _counters[path] = MergeCounter(path)
        counter = _counters[path]
        for batch in batches:
            for part in slices(batch):
                n = [counter.count(t or "") for t in part.column("text").to_pylist()]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n])})

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select("doc_id", "text", size).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
