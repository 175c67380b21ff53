"""Sequence ratios of batches against the standard library's."""

import random
import time
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from proofmill.functions import matching as M


def library(left, right):
    return [SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(left, right, strict=True)]


@given(st.lists(st.tuples(st.text(alphabet="abc ", max_size=25), st.text(alphabet="abc ", max_size=25)), min_size=1, max_size=30))
@settings(max_examples=300, deadline=None)
def test_short_strings(pairs):
    left, right = [p[0] for p in pairs], [p[1] for p in pairs]
    assert M.ratios(left, right).tolist() == library(left, right)


def test_long_strings_leave_frequent_characters_out():
    rng = random.Random(1)
    make = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    left, right = [], []
    for letters in ("ab", "abcdefghij", "abcdefghijklmnopqrstuvwxyz0123456789 %", "aaaaaaaaaaaaaaaab", "étß𝒳日本 "):
        for a, b in ((199, 200), (200, 199), (210, 450), (500, 230), (1, 300), (300, 1), (250, 250)):
            left += (x := [make(a, letters) for _ in range(4)])
            right += [make(b, letters) for _ in range(3)] + [x[3][:100] + make(100, letters) + x[3][100:]]
    # a frequent character at the very beginning, and only frequent ones
    left += ["a" * 30 + "xyz", "aaaa", "b" + "a" * 250]
    right += ["a" * 250 + "xyz", "a" * 300, "a" * 220 + "b" + "a" * 30]
    assert M.ratios(left, right).tolist() == library(left, right)


def test_edges():
    assert M.ratios([], []).tolist() == []
    assert M.ratios(["", "a", "", "\ud800"], ["", "", "b", "\ud800"]).tolist() == [0.0, 0.0, 0.0, 1.0]
    x, y = "x" * 3000, "y" + "x" * 2999
    assert M.ratios([x, x], [y, x]).tolist() == library([x, x], [y, x])


def test_less_work_than_a_call_a_pair():
    rng = random.Random(2)
    words = "net sales total revenue of the group in fiscal year order value gross operating profit before tax apple inc".split()
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(2, 8)))
    left, right = [make() for _ in range(3000)], [make() for _ in range(3000)]
    M.ratios(left[:10], right[:10])
    took = []
    for f in (M.ratios, library):
        began = time.process_time()
        f(left, right)
        took.append(time.process_time() - began)
    print("seconds", took)
    assert took[0] * 3 < took[1]
