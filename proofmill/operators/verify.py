"""Evidence verification: a quote must occur in its block, exactly or nearly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.functions import matching
from proofmill.functions.text import verify_normalize

NEAR = 0.92
PIECE = 1 << 14  # windows that are bounded at once
TRIED = 4  # windows of a quote that are compared at once


def _bounds(text: list[str], n: int, known: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """No window of n words can have a higher ratio; ``known`` are the quote's characters besides spaces, ``length`` is its own."""
    sizes = np.array([len(w) for w in text])
    before = np.concatenate([[0], np.cumsum(sizes)])
    letters = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.minimum(np.searchsorted(known, letters), len(known) - 1)
    mine = known[kind] == letters
    word = np.repeat(np.arange(len(text)), sizes)
    by_word = np.bincount(word[mine] * len(known) + kind[mine], minlength=len(text) * len(known)).reshape(len(text), -1)
    total = np.concatenate([np.zeros((1, len(known)), np.int64), np.cumsum(by_word, axis=0)])
    common = np.minimum(total[n:] - total[:-n], count).sum(axis=1) + n - 1
    return 2.0 * common / (before[n:] - before[:-n] + n - 1 + length)


def near_windows(quote: str, block: str, enough: float = NEAR) -> tuple[str, list[str]]:
    """The quote, and the windows of the block as long as it in words that may be near enough, likeliest first.

    The characters that a window has in common with the quote, counted by word for ``PIECE``
    windows at once, bound the ratio from above.
    """
    words, text = quote.split(), block.split()
    n = len(words)
    quote = " ".join(words)
    if n < 4 or len(text) < n:
        return quote, []
    known, count = np.unique(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    bound = np.concatenate([_bounds(text[at : at + PIECE + n - 1], n, known, count, len(quote)) for at in range(0, len(text) - n + 1, PIECE)])
    found = np.flatnonzero(bound >= enough)
    return quote, [" ".join(text[i : i + n]) for i in found[np.argsort(-bound[found], kind="stable")].tolist()]


def any_near(quotes: list[str], windows: list[list[str]], enough: float = NEAR) -> np.ndarray:
    """Whether one of each quote's windows is near enough: a few windows of every open quote at a time."""
    found, at = np.zeros(len(quotes), bool), 0
    open_ = [k for k, w in enumerate(windows) if w]
    while open_:
        asked = [(k, w) for k in open_ for w in windows[k][at : at + TRIED]]
        at += TRIED
        ratio = matching.ratios([quotes[k] for k, _ in asked], [w for _, w in asked])
        found[[k for (k, _), r in zip(asked, ratio.tolist(), strict=True) if r >= enough]] = True
        open_ = [k for k in open_ if not found[k] and len(windows[k]) > at]
    return found


def best_window(quote: str, block: str, enough: float = NEAR) -> bool:
    """Whether a window of the block as long as the quote in words is near enough."""
    quote, windows = near_windows(quote, block, enough)
    return bool(any_near([quote], [windows], enough)[0])


@F.pandas_udf(T.BooleanType())
def _near(quote: pd.Series, block: pd.Series) -> pd.Series:
    """False where the quote is null."""
    tried = [near_windows(q, b) if q is not None else ("", []) for q, b in zip(quote, block, strict=True)]
    return pd.Series(any_near([q for q, _ in tried], [w for _, w in tried]), dtype=bool)


def verify(quoted: DataFrame, quote: str = "evidence_quote", block: str = "block_text") -> DataFrame:
    """Add ``verified`` and ``match`` (exact, near, none); texts whose quote occurs exactly don't reach Python."""
    n = quoted.withColumns({"_q": verify_normalize(F.col(quote)), "_b": verify_normalize(F.col(block))}).withColumn("_exact", (F.col("_q") != "") & F.contains(F.col("_b"), F.col("_q")))
    open_ = ~F.col("_exact") & (F.col("_q") != "")
    near = n.withColumn("_near", _near(F.when(open_, F.col("_q")), F.when(open_, F.col("_b"))))
    match = F.when(F.col("_exact"), "exact").when(F.col("_near"), "near").otherwise("none")
    return near.withColumn("match", match).withColumn("verified", F.col("match") != "none").drop("_q", "_b", "_exact", "_near")


def attach_blocks(raw_claims: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw claims with their block's text and page, and those that name no block."""
    found = blocks.select(F.col("id").alias("block_id"), "document_id", F.col("text").alias("block_text"), "page")
    return raw_claims.join(found, ["document_id", "block_id"]), raw_claims.join(found.select("document_id", "block_id"), ["document_id", "block_id"], "left_anti")
