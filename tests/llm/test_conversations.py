"""Conversation repair against plain searches."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from proofmill.llm import conversations as C

PATTERN = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\v\f\r"


def plain_best(rows):
    """(cost, audit) of the cheapest edits by a search that keeps whole strings. Rows: (initial, faulty, cut off)."""
    best = {"": (0, "")}  # by what of the pattern is there: nothing, s, u, a

    def insert(now):
        for to, frm in (("u", ("", "s", "a")), ("a", ("u",)), ("u", ("a",))):
            for f in frm:
                if f in now:
                    x = (now[f][0] + 5, now[f][1] + "I")
                    if to not in now or x < now[to]:
                        now[to] = x
        return now

    for initial, faulty, cut in rows:
        best, new = insert(dict(best)), {}
        for at, (cost, audit) in best.items():
            steps = [(at, 2, "D")]
            if not faulty:
                extra = 5 if cut else 0
                if at == "" and initial == "s":
                    steps.append(("s", extra, "K"))
                to = "a" if at == "u" else "u"
                if initial == to:
                    steps.append((to, extra, "K"))
                steps.append((to, extra + 1, "R"))
            for to, c, e in steps:
                x = (cost + c, audit + e)
                if to not in new or x < new[to]:
                    new[to] = x
        best = new
    best = insert(dict(best))
    return min(best[x] for x in ("", "a") if x in best)


def every_best(rows):
    """The same by trying all edits, with up to two inserted rows at a place."""
    found = []
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        if sum(inserts) > 3:
            continue
        for kinds in itertools.product("DKua", repeat=len(rows)):
            slots, cost, audit, ok = [], 5 * sum(inserts), "", True
            for k, ((initial, faulty, cut), kind) in enumerate(zip(rows, kinds, strict=True)):
                slots += ["ua"] * inserts[k]
                audit += "I" * inserts[k]
                ok &= kind == "D" or not faulty
                audit += kind if kind in "DK" else "R"
                cost += 2 if kind == "D" else (5 if cut else 0) + (kind in "ua")
                if kind != "D":
                    slots.append(initial if kind == "K" else kind)
            slots += ["ua"] * inserts[-1]
            audit += "I" * inserts[-1]
            if ok and any(PATTERN.fullmatch("".join(x)) for x in itertools.product(*slots)):
                found.append((cost, audit))
    return min(found)


def searched(rows):
    search, out = C.Repair(), []
    for i, (initial, faulty, cut) in enumerate(rows):
        out += search.add(i, initial, faulty, cut)
    out += search.end()
    return search.cost, "".join(x.edit for x in out)


def some_rows(rng, n):
    return [(rng.choice("ssuuuaaat"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]


def test_every_edit_of_short_conversations():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4):
        for _ in range(25 if n < 4 else 8):
            rows = some_rows(rng, n)
            assert plain_best(rows) == every_best(rows), rows


def test_search_equals_plain_search():
    rng = random.Random(2)
    for _ in range(3000):
        rows = some_rows(rng, rng.randrange(0, 30))
        assert searched(rows) == plain_best(rows), rows


def test_ties_that_stay_open_to_the_end():
    for n in (9, 10, 51):
        rows = [("u", False, False)] * n
        assert searched(rows) == plain_best(rows)


def test_memory_is_that_after_the_last_common_edit():
    search, given = C.Repair(), 0
    for i in range(2000):
        given += len(search.add(i, "ua"[i % 2], False, False))
        assert i + 1 - given <= 6
    held, stack = set(), [x[1] for x in search.alive if x]
    while stack:
        x = stack.pop()
        if x is not None and id(x) not in held:
            held.add(id(x))
            stack.append(x.parent)
    assert len(held) <= 12


def fault_of(role, text, seen):
    if not text.strip(SPACE):
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return None if text.strip(SPACE)[-1] in ".!?" else "truncated"


def whole(conversations):
    """Rows of the query by plain Python; conversations: conv_id to (turn, role, text) rows."""
    out = {}
    for conv, rows in conversations.items():
        after = []
        for turn, role, text in rows:
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in after:
            faults.append(fault_of(role, text, seen))
            seen.add((role, text))
        cost, audit = plain_best([(role[:1], f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(after, faults, strict=True)])
        left, it = [], iter(after)
        for e in audit:
            row = None if e == "I" else next(it)
            if e != "D":
                expected = "u" if not left or left[-1][0][:1] in ("s", "a") else "a"
                left.append((row[1], row[2]) if e == "K" else ({"u": "user", "a": "assistant"}[expected], row[2] if row else ""))
        turns = [r[0] for r in after if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha)
    return out


def grouped(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def answers(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_query_equals_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    assert answers(C.op12_conversation_repair(spark, "/root/testdata/sf0.01")) == whole(grouped(rows))


ODD = [
    *((1, t, r, x) for t, r, x in [(0, "user", "Hi."), (0, "user", "Hi."), (None, None, None), (None, "system", "Be brief."), (3, "", "x"), (4, "tool", "ran!"), (9, "Assistant", "…?"), (2**62, "assistant", " \t")]),
    *((None, t, "user", "same text.") for t in range(40)),
    *((7, None, "assistant", x) for x in ("b.", "a.", None, "")),
    (8, 1, "user", "long " * 300_000 + "."),
    (8, 2, "assistant", "done." + " " * 200_000),
    *((conv, 0, "user", "one.") for conv in range(100, 160)),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, tmp_path, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.selectExpr("*", "1 as fault", "2 as _same", "3 as edit").write.parquet(f"{tmp_path}/conversations.parquet")
    assert answers(C.op12_conversation_repair(spark, str(tmp_path))) == whole(grouped(rows))
