"""Exact tokenizer ids by chunks: texts are cut where the tokenizer cuts anyway, and each chunk is encoded once.

A tokenizer whose pre-tokenizer starts a new piece at a space between two
non-space characters gives the same ids for a text and for its chunks. Both
tokenizers used here do; they also part a run of letters from what follows. Chunks
and runs recur, so a worker keeps bounded tables of their ids (``memo.Recent``), in
which common ones stay. Every id comes from the tokenizers library.

Where runs can be told apart by line ends, texts are cut at once, as bytes, into the
runs of plain chunks and into whole other chunks; each different one of a call is looked
up once, and ids are gathered by Arrow.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa

from proofmill.llm import memo
from proofmill.llm.vec import text_buffers

#: A space at an end of the text or beside other white space: such texts are cut more carefully.
_ODD = re.compile(r"(?:^|\s) | (?:\s|$)")
_RARE_SPACE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Chunks that are cut at their runs of letters: no apostrophe (contractions), no white space but single line ends.
_PLAIN = re.compile(rf"[{_LETTER}!-&(-@\[-`{{-~\n]+")
_RUNS = re.compile(rf"[{_LETTER}]+|[^{_LETTER}]+")
_RUN = re.compile(rf" ?[{_LETTER}]+")
#: The same by UTF-8 bytes: letters (or the first byte of one), and bytes that no plain chunk has.
_LETTERS = np.array([chr(b).isalpha() if b < 128 else b == 0xC3 for b in range(256)])
_UNPLAIN = np.array([b > 126 and b != 0xC3 or b < 32 and b != 10 or b == 39 for b in range(256)])
_LONGEST = 64
_BATCH = 512
KEEP = 250_000


class ChunkEncoder:
    """Encodes texts to little-endian id bytes; at most twice ``keep`` chunks and as many runs stay in memory."""

    def __init__(self, path: str, dtype: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        # a special string splits a text before anything else looks at it: joined by one, chunks are encoded many at a time
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.joint, self.joint_id = next(iter(self.special.items()), ("", -1))
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        # runs of letters are told apart by the suffix of their last id, or by the id of a line end between them
        self.ends = np.array(sorted(i for t, i in vocabulary.items() if suffix and t.endswith(suffix)))
        self.line_end = vocabulary.get("Ċ")
        self.folds = suffix is not None and self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("Éa") == "éa"
        self.inner = memo.Recent(keep)  # chunks without the space before them
        self.runs = memo.Recent(keep)

    def _joined(self, parts: list[str], joint: str) -> np.ndarray:
        [e] = self.tokenizer.encode_batch_fast([joint.join(parts)], add_special_tokens=False)
        return np.array(e.ids, dtype=self.dtype)

    def _split(self, ids: np.ndarray, at: np.ndarray, skip: int) -> list[bytes]:
        """Id bytes up to each index of ``at``, which itself is left out if ``skip``."""
        raw, width = ids.tobytes(), self.dtype.itemsize
        stops = ((at + 1 - skip) * width).tolist()
        starts = [0, *((at + 1) * width).tolist()]
        if skip:
            stops.append(len(raw))
        return [raw[a:b] for a, b in zip(starts, stops)]  # noqa: B905  the last start may have no stop

    def _ids(self, chunks: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(chunks), _BATCH):
            some = chunks[k : k + _BATCH]
            if len(some) > 1 and self.joint and not any(x in c for x in self.special for c in some):
                ids = self._joined(some, self.joint)
                out += self._split(ids, np.flatnonzero(ids == self.joint_id), 1)
            else:
                out += [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def _letters(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of letters, with or without a space before them."""
        out = []
        for k in range(0, len(runs), _BATCH):
            some = runs[k : k + _BATCH]
            if len(self.ends):
                ids = self._joined(some, " ")
                got = self._split(ids, np.flatnonzero(np.isin(ids, self.ends)), 0)
            else:
                ids = self._joined(some, "\n")
                got = self._split(ids, np.flatnonzero(ids == self.line_end), 1)
            if len(got) != len(some):
                raise ValueError("this tokenizer doesn't keep runs of letters apart")
            out += got
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Add unknown chunks (without their space) to the table."""
        rest, plans, letters, others = [], [], {}, {}
        inner, known, runs = self.inner.new, self.runs.get, self.runs.new
        plain, cut, marked = _PLAIN.fullmatch, _RUNS.findall, bool(len(self.ends))
        for c in chunks:
            if self.line_end is None or not plain(c) or "\n\n" in c or "<|" in c:
                rest.append(c)
                continue
            parts = cut(c.lower() if self.folds else c)
            if not (marked and parts[0][0].isalpha()):
                parts[0] = " " + parts[0]
            plans.append((c, parts))
            for p in parts:
                if p not in runs and known(p) is None:
                    (letters if p[-1].isalpha() else others)[p] = None
        runs.update(zip(letters, self._letters(list(letters)), strict=True))
        runs.update(zip(others, self._ids(list(others)), strict=True))
        for c, parts in plans:
            inner[c] = runs[parts[0]] if len(parts) == 1 else b"".join([runs[p] for p in parts])
        inner.update(zip(rest, self._ids([" " + c for c in rest]), strict=True))
        self.runs.turn()

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces."""
        runs = self.runs.new
        ids = list(map(runs.get, pieces))
        letters, others = [], []
        for i in [i for i, x in enumerate(ids) if x is None]:
            ids[i] = self.runs.get(pieces[i])
            if ids[i] is None:
                (letters if _RUN.fullmatch(pieces[i]) else others).append(i)
        for some, encode in ((letters, self._letters), (others, self._ids)):
            names = [pieces[i] for i in some]
            for i, name, got in zip(some, names, encode(names), strict=True):
                ids[i] = got
                if len(name) <= _LONGEST:
                    runs[name] = got
        self.runs.turn()
        return ids

    def _encode_runs(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that aren't odd: each different piece is looked up once."""
        data, offs = text_buffers(pa.array(texts, pa.large_string()))
        starts = _pieces(data, offs)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        coded = pa.LargeStringArray.from_buffers(len(starts), bounds, pa.py_buffer(data)).dictionary_encode()
        ids = self._known(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(np.frombuffer(b"".join(ids), self.dtype)))
        raw = lists.take(coded.indices).flatten().to_numpy().tobytes()
        before = np.concatenate([[0], np.cumsum(sizes[coded.indices.to_numpy()])])
        ends = (before[np.searchsorted(starts, offs)] * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in itertools.pairwise(ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of ``dtype``."""
        if self.line_end is None or len(self.ends) or self.folds:
            return self._encode_chunks(texts)
        odd = [_is_odd(t) for t in texts]
        ways = {x: iter(way([t for t, o in zip(texts, odd, strict=True) if o == x])) for x, way in ((False, self._encode_runs), (True, self._encode_chunks))}
        return [next(ways[x]) for x in odd]

    def _encode_chunks(self, texts: list[str]) -> list[bytes]:
        inner, aged, heads, plans, unknown = self.inner.new, self.inner.get, {}, [], {}
        for text in texts:
            if _is_odd(text):
                first, *rest = _CUT.split(text)
                rest = [p[1:] for p in rest]
            else:
                first, *rest = text.split(" ")
            ids = list(map(inner.get, rest))
            missing = []
            if None in ids:
                for i, x in enumerate(ids):
                    if x is None:
                        ids[i] = x = aged(rest[i])
                        if x is None:
                            missing.append(i)
                            unknown[rest[i]] = None
            heads[first] = b""
            plans.append((first, ids, [(i, rest[i]) for i in missing]))
        new = list(unknown)
        self._learn(new)
        names = list(heads)
        heads.update(zip(names, self._ids(names), strict=True))
        out = []
        for first, ids, missing in plans:
            for i, c in missing:
                ids[i] = inner[c]
            out.append(b"".join([heads[first], *ids]))
        for c in new:
            if len(c) > _LONGEST:
                del inner[c]
        self.inner.turn()
        return out


def _pieces(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pieces of the texts begin: each chunk with the space before it, and in plain chunks, but a text's first, each run of letters or of others."""
    letter, unplain = _LETTERS[data], _UNPLAIN[data]
    accented = np.flatnonzero(data == 0xC3) + 1
    letter[accented] = True
    unplain[accented] = (data[accented] == 0x97) | (data[accented] == 0xB7)  # the signs among them
    last, now = data[:-1], data[1:]
    unplain[1:] |= ((last == 10) & (now == 10)) | ((last == ord("<")) & (now == ord("|")))
    first = offs[:-1][offs[1:] > offs[:-1]]
    cut = data == 32
    cut[first] = True
    chunks = np.flatnonzero(cut)
    if not len(chunks):
        return chunks
    whole = np.logical_or.reduceat(unplain, chunks)
    whole[np.searchsorted(chunks, first)] = True
    inside = ~np.repeat(whole, np.diff(np.append(chunks, len(data))))
    cut[1:] |= (letter[1:] != letter[:-1]) & (last != 32) & inside[1:]
    return np.flatnonzero(cut)


def _is_odd(text: str) -> bool:
    if _RARE_SPACE.search(text):
        return _ODD.search(text) is not None
    return "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, dtype: str, keep: int = KEEP) -> ChunkEncoder:
    """The worker's encoder of this file, kept from task to task; the task is marked by ``memo.task("chunks")``."""
    memo.keeps("chunks", _encoders.clear)
    key = (path, dtype, keep)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(path, dtype, keep)
    return _encoders[key]
