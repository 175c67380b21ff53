"""Vector bin packing of token pieces into fixed-size sequences.

A text of more than ``max_tokens`` ids is cut into full pieces and one rest.
Full pieces fill a sequence each and are named at once. Rests are spread evenly
over blocks of a bounded number of pieces; in a block, a sequence is filled by the
rest with the largest dot product of its demand (tokens, one segment, loss-bearing
tokens) and the sequence's free room, among those that fit in all three, until none
fits. Blocks are independent tasks, so nothing is gathered in one place.

``cut_pieces`` makes pieces of plain documents, all of whose ids bear loss, so the
limit on tokens is the one that binds; ``cut_conversations`` makes one example of
each conversation, in which only the ids of given roles bear loss, so that any of
the three limits can bind.

Null and empty texts are one piece of the end id. Repeated rows are packed each.
A piece with more loss-bearing tokens than a sequence may hold fits nowhere and is
an error. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import memo
from proofmill.llm.chunks import KEEP, encoder
from proofmill.llm.shared import table, written
from proofmill.llm.vec import slices

MAX_TOKENS, MAX_SEGMENTS = 4096, 1024
BLOCK = 8192
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, by the dot-product heuristic; limits: tokens, segments, loss-bearing tokens."""
    order = np.lexsort((-loss, -tokens))
    left, size, lossy = order, tokens[order].astype(float), loss[order].astype(float)
    scale = np.array([1 / x**2 for x in limits])
    bins, offsets = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    k = 0
    while len(left):
        room = np.array(limits, float)
        alive = np.ones(len(left), bool)
        while room[1] >= 1:
            fits = np.flatnonzero(alive & (size <= room[0]) & (lossy <= room[2]))
            if not len(fits):
                break
            score = size[fits] * (room[0] * scale[0]) + room[1] * scale[1] + lossy[fits] * (room[2] * scale[2])
            i = fits[int(score.argmax())]
            bins[left[i]], offsets[left[i]] = k, limits[0] - int(room[0])
            room -= (size[i], 1, lossy[i])
            alive[i] = False
        left, size, lossy = left[alive], size[alive], lossy[alive]
        k += 1
    return bins, offsets


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int, keep: int = KEEP) -> DataFrame:
    """Pieces of each document's ids with their checksums; of plain documents every id bears loss. ``keep`` bounds the encoder's table."""
    end = np.array([end_id], "<u4").tobytes()

    @memo.task("chunks")
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "<u4", keep)
        for batch in batches:
            for part in slices(batch):
                out = []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, max_tokens):
                        piece = ids[4 * at : 4 * (at + max_tokens)]
                        out.append((doc_id, at, len(piece) // 4, zlib.crc32(piece), n, len(piece) // 4))
                yield _pieces(out)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def cut_conversations(turns: DataFrame, tokenizer: str, end_id: int, max_tokens: int, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Pieces of conversations (conv_id, turn, role, text), the turns in order, each with the end id after it.

    A conversation is one example, cut only where it is longer than a sequence. Ids of
    ``loss_roles`` bear loss. Null texts are empty, null roles bear no loss.
    """
    end = np.array([end_id], "<u4").tobytes()
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")).select(F.col("conv_id").alias("doc_id"), F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    @memo.task("chunks")
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "<u4")
        for batch in batches:
            out = []
            for doc_id, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "roles", "texts")), strict=True):
                ids = [x + end for x in enc.encode([t or "" for t in texts])]
                bears = np.concatenate([np.full(len(x) // 4, role in loss_roles) for x, role in zip(ids, roles, strict=True)])
                ids = b"".join(ids)
                n = len(ids) // 4
                for at in range(0, n, max_tokens):
                    piece = ids[4 * at : 4 * (at + max_tokens)]
                    out.append((doc_id, at, len(piece) // 4, zlib.crc32(piece), n, int(bears[at : at + max_tokens].sum())))
            yield _pieces(out)

    return whole.mapInArrow(cut, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch({c.split()[0]: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(PIECES.split(", "))})


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_TOKENS, block: int = BLOCK) -> DataFrame:
    """Give each piece (columns of PIECES) a sequence and an offset there."""
    if max_loss < max_tokens:
        over = pieces.filter(F.col("loss") > max_loss).limit(1).count()
        if over:
            raise ValueError("a piece has more loss-bearing tokens than a sequence may hold")
    pieces = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    names = [c.split()[0] for c in PACKED.split(", ")]
    # sequences of full pieces have odd names, those of blocks even ones
    full = pieces.filter(F.col("length") >= max_tokens).withColumns({"sequence_id": 2 * F.col("row") + 1, "offset": F.lit(0).cast("long")}).select(names)
    rests = pieces.filter(F.col("length") < max_tokens)
    blocks = max(1, -(-rests.count() // block))
    limits = (max_tokens, max_segments, max_loss)

    def place(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", ignore_index=True)
        bins, offsets = fill(frame["length"].to_numpy(), frame["loss"].to_numpy(), limits)
        frame["sequence_id"], frame["offset"] = 2 * ((int(key[0]) << 32) + bins), offsets
        return frame[names]

    dealt = rests.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return full.unionByName(dealt.groupBy("block").applyInPandas(place, PACKED))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, MAX_TOKENS, 600_000))
