"""Sequence ratios of many string pairs at once.

The ratio counts the characters of the longest common block of two strings, then of what
lies left and right of it, and so on. All open parts of all pairs go through one table of
block lengths a row at a time, so a step works on whole arrays. Of equally long blocks the
one that ends first in the left string counts, then the one that starts first in the right
one. In a right string of ``LONG`` characters or more, characters that make up more than a
hundredth of it can't begin a block, but can lengthen one.
"""

from __future__ import annotations

import numpy as np

#: From which length on frequent characters are left out, and how frequent they are.
LONG, SHARE = 200, 100
CELLS = 1 << 16  # of a table's row: pairs times right characters
NEVER, PAD = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings in a row, and where each begins."""
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings], dtype=np.int64)])
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def _without_frequent(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes with frequent characters of long strings replaced, and which strings have such characters."""
    kept, touched = codes, np.zeros(len(offsets) - 1, bool)
    for k in np.flatnonzero(np.diff(offsets) >= LONG).tolist():
        part = codes[offsets[k] : offsets[k + 1]]
        _, inverse, count = np.unique(part, return_inverse=True, return_counts=True)
        frequent = (count > len(part) // SHARE + 1)[inverse]
        if frequent.any():
            kept = kept.copy() if kept is codes else kept
            kept[offsets[k] : offsets[k + 1]][frequent] = NEVER
            touched[k] = True
    return kept, touched


def _gathered(codes: np.ndarray, low: np.ndarray, size: np.ndarray, pad: np.uint32) -> np.ndarray:
    """A column for each part, padded at its end."""
    at = np.arange(size.max())[:, None]
    inside = at < size
    return np.where(inside, codes[np.minimum(low + at, len(codes) - 1)], pad)


def _longest(a: np.ndarray, b: np.ndarray, a_low: np.ndarray, a_size: np.ndarray, b_low: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each part's longest block, and where it begins on both sides; length 0 at the part's beginning."""
    left, right = _gathered(a, a_low, a_size, PAD), _gathered(b, b_low, b_size, NEVER)
    n, kind = left.shape[1], np.int16 if right.shape[0] < 2**15 else np.int32
    before, now = np.zeros((right.shape[0] + 1, n), kind), np.zeros((right.shape[0] + 1, n), kind)
    best, a_end, b_end = np.zeros(n, kind), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(left.shape[0]):
        np.add(before[:-1], 1, out=now[1:])
        now[1:] *= right == left[i]
        top = now.max(axis=0)
        better = np.flatnonzero(top > best)
        if len(better):
            best[better], a_end[better], b_end[better] = top[better], i + 1, now[:, better].argmax(axis=0)
        before, now = now, before
    return best.astype(np.int64), a_low + a_end - best, b_low + b_end - best


def _chunks(a_size: np.ndarray, b_size: np.ndarray):
    """Parts of about one size, as many as ``CELLS`` allows."""
    order = np.lexsort((b_size, a_size // 4))
    at = 0
    while at < len(order):
        end = at + max(1, CELLS // int(b_size[order[at]]))
        while True:  # the widest of a chunk sets its width
            taken = order[at:end]
            fits = max(1, CELLS // int(b_size[taken].max()))
            if len(taken) <= fits:
                break
            end = at + fits
        yield taken
        at += len(taken)


def matched(left: list[str], right: list[str]) -> np.ndarray:
    """For each pair, how many characters its common blocks have."""
    a, a_offsets = _codes(left)
    b, b_offsets = _codes(right)
    plain, touched = _without_frequent(b, b_offsets)
    total = np.zeros(len(left), np.int64)
    parts = (np.arange(len(left)), a_offsets[:-1], a_offsets[1:], b_offsets[:-1], b_offsets[1:])
    while True:
        pair, a_low, a_high, b_low, b_high = (x[(parts[2] > parts[1]) & (parts[4] > parts[3])] for x in parts)
        if not len(pair):
            return total
        following = []
        for at in _chunks(a_high - a_low, b_high - b_low):
            p, al, ah, bl, bh = pair[at], a_low[at], a_high[at], b_low[at], b_high[at]
            size, i, j = _longest(a, plain, al, ah - al, bl, bh - bl)
            if touched[p].any():
                size, i, j = _lengthened(a, b, size, i, j, al, ah, bl, bh)
            np.add.at(total, p, size)
            some = size > 0
            for new in ((p, al, i, bl, j), (p, i + size, ah, j + size, bh)):
                following.append([x[some] for x in new])
        parts = tuple(np.concatenate(x) for x in zip(*following, strict=True))


def _lengthened(a, b, size, i, j, al, ah, bl, bh):
    """Blocks with the equal characters before and after them; only frequent ones are left there."""
    size, i, j = size.copy(), i.copy(), j.copy()
    while len(more := np.flatnonzero((i > al) & (j > bl) & (a[i - 1] == b[j - 1]))):
        size[more], i[more], j[more] = size[more] + 1, i[more] - 1, j[more] - 1
    while True:
        x, y = i + size, j + size
        more = np.flatnonzero((x < ah) & (y < bh) & (a[np.minimum(x, len(a) - 1)] == b[np.minimum(y, len(b) - 1)]))
        if not len(more):
            return size, i, j
        size[more] += 1


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Twice the matched characters over all characters of each pair; 0 if either is empty."""
    length = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], dtype=float)
    some = np.array([bool(x) and bool(y) for x, y in zip(left, right, strict=True)], dtype=bool)
    return np.where(some, 2.0 * matched(left, right) / np.maximum(length, 1), 0.0)
