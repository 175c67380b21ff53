"""Conversation repair: the cheapest edits after which roles alternate, by a Viterbi search that forgets.

A repaired conversation is empty, or an optional system row and then user and assistant
rows in turn. The search reads a conversation's rows in order and keeps one survivor for
each place in that pattern: its cost and a node of a tree of back pointers, whose nodes
count what points at them. A node that nothing points at goes, and with it what only it
held. Once all survivors descend from one node, the edits up to it are final: they are
given out, and their rows' texts leave memory. Equal costs are told apart by the whole
edit strings, of which only the part after the last common node has to be compared.
A survivor is dropped when another one, at its worst, ends cheaper.

Edits: Keep 0; Rerole to user or assistant 1; Delete 2, the only one for blank rows and
duplicates; Insert an empty user or assistant row 5; a truncated row that isn't deleted
adds 5. Ties go to the edit string that is least in ASCII.

A conversation's rows stream through one task in order: its result is one string and one
hash over all of them, so it can't be had from parts. The task holds the rows after the
last common node only. Which rows are duplicates is settled before, by a window over the
same shuffle, so no set of seen rows is kept.

Defined results: null roles and texts are one space; rows without a conversation are one
conversation; null turns come first. Rows of equal turn are taken in the order of role,
then text; repeated rows are duplicates of the first. A role that begins with none of
s, u and a can't be kept. Gaps that no long can hold are null. Other columns are not
read, so their names don't matter. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.llm import memo
from proofmill.llm.shared import table

KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLED, DELETED, INSERTED, CUT_OFF = 1, 2, 5, 5
#: White space is `[\x20\x09-\x0D]`.
SPACE = r"[\x20\x09-\x0D]"
#: Places in the pattern: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
BEFORE_USER = (START, SYSTEM, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
ROWS = 4096  # of a batch given out


class _Node:
    """An edit: its letter, what it puts out (role, text, and the row it came from), its parent, and what points at it."""

    __slots__ = ("edit", "row", "role", "parent", "refs", "depth")

    def __init__(self, edit: str, row, role: str | None, parent: _Node | None):
        self.edit, self.row, self.role, self.parent, self.refs = edit, row, role, parent, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.refs += 1


def _freed(node: _Node | None) -> None:
    """One pointer less at the node; what nothing points at goes."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        above, node.parent = node.parent, None
        node = above


def _less(x: _Node, more_x: str, y: _Node, more_y: str) -> bool:
    """Whether the edits up to x and then more_x are before those of y, compared from their last common node on."""
    a, b = [], []
    while x is not y:
        if x.depth >= y.depth:
            a.append(x.edit)
            x = x.parent
        else:
            b.append(y.edit)
            y = y.parent
    return "".join(reversed(a)) + more_x < "".join(reversed(b)) + more_y


class Repair:
    """One conversation: ``add`` its rows in order, then ``end``; both return the edits that have become final, as nodes."""

    def __init__(self):
        self.root = _Node("", None, None, None)
        self.root.refs = 1
        self.alive: list[tuple[int, _Node] | None] = [(0, self.root), None, None, None]
        self.cost = 0

    def _best(self, offers: list[tuple[int, int, str, str | None]]) -> tuple[int, int, str, str | None] | None:
        """The best of (cost, place before, edit, role)."""
        best = None
        for x in offers:
            if best is None or x[0] < best[0] or (x[0] == best[0] and _less(self.alive[x[1]][1], x[2], self.alive[best[1]][1], best[2])):
                best = x
        return best

    def _move(self, row, offers: list[list]) -> None:
        chosen = [self._best(x) for x in offers]
        new = [None if x is None else (x[0], _Node(x[2], row, x[3], self.alive[x[1]][1])) for x in chosen]
        for x in new:
            if x:
                x[1].refs += 1
        for x in self.alive:
            if x:
                _freed(x[1])
        self.alive = new

    def _inserted(self) -> None:
        """Reach places by an inserted row where that is better: more than one at a place never pays, as deleting is cheaper."""
        for place, before in ((USER, BEFORE_USER), (ASSISTANT, (USER,))):
            best = self._best([(self.alive[p][0] + INSERTED, p, INSERT, ROLES[place]) for p in before if self.alive[p]])
            now = self.alive[place]
            if best and (now is None or best[0] < now[0] or (best[0] == now[0] and _less(self.alive[best[1]][1], INSERT, now[1], ""))):
                node = _Node(INSERT, None, best[3], self.alive[best[1]][1])
                node.refs += 1
                if now:
                    _freed(now[1])
                self.alive[place] = (best[0], node)

    def _pruned(self) -> None:
        """Drop the survivors of START and SYSTEM that can no longer win.

        What follows after either can follow an assistant row too: a system row kept later costs at most 2 more if
        deleted instead, and nothing else differs.
        """
        other = self.alive[ASSISTANT]
        for place, margin in ((START, DELETED), (SYSTEM, 0)):
            mine = self.alive[place]
            if other and mine and mine[0] > other[0] + margin:
                _freed(mine[1])
                self.alive[place] = None

    def _final(self) -> list[_Node]:
        """The edits that all survivors share and that weren't given out."""
        if self.root.refs > 1 or any(x and x[1] is self.root for x in self.alive):
            return []
        path, node = [], next(x[1] for x in self.alive if x)
        while node is not self.root:
            path.append(node)
            node = node.parent
        held = {id(x[1]) for x in self.alive if x}
        out = []
        while path:
            node = path.pop()
            out.append(node)
            # the node is the new root: nothing before it is needed again
            self.root, node.parent = node, None
            if node.refs > 1 or id(node) in held:
                break
        return out

    def add(self, row, initial: str, faulty: bool, cut_off: bool) -> list[_Node]:
        """``row`` comes back in the node; ``faulty`` rows (blank, duplicate) can only be deleted."""
        self._inserted()
        extra = CUT_OFF if cut_off else 0
        offers: list[list] = [[(x[0] + DELETED, place, DELETE, None)] if x else [] for place, x in enumerate(self.alive)]
        if not faulty:
            if initial == "s" and self.alive[START]:
                offers[SYSTEM].append((self.alive[START][0] + extra, START, KEEP, None))
            for place, before, own in ((USER, BEFORE_USER, "u"), (ASSISTANT, (USER,), "a")):
                edit, cost, role = (KEEP, extra, None) if initial == own else (REROLE, extra + REROLED, ROLES[place])
                offers[place] += [(self.alive[p][0] + cost, p, edit, role) for p in before if self.alive[p]]
        self._move(row, offers)
        self._pruned()
        return self._final()

    def end(self) -> list[_Node]:
        self._inserted()
        places = [p for p in (START, ASSISTANT) if self.alive[p]]
        best = self._best([(self.alive[p][0], p, "", None) for p in places])
        for place in range(4):
            if place != best[1] and self.alive[place]:
                _freed(self.alive[place][1])
                self.alive[place] = None
        self.cost = best[0]
        path, node = [], self.alive[best[1]][1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        return path[::-1]


EDITS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()), ("was", pa.string()), ("fault", pa.string()), ("role", pa.string()), ("text", pa.string())])


@memo.task()
def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    key, search = None, None

    def keep(nodes: list[_Node]) -> None:
        for x in nodes:
            turn, was, fault, text = x.row or (None, None, None, "")
            gone = x.edit == DELETE
            out.append((key[0], turn, x.edit, was, fault, None if gone else x.role or was, None if gone else text))

    def shown() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), EDITS.types, strict=True)], schema=EDITS)
        out.clear()
        return made

    for batch in batches:
        size = 0
        for conv, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")), strict=True):
            if key != (conv,):
                if search:
                    keep(search.end())
                key, search = (conv,), Repair()
            keep(search.add((turn, role, fault, text), role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
            size += len(text)
            if len(out) >= ROWS or size > 1 << 20:
                size = 0
                if out:
                    yield shown()
    if search:
        keep(search.end())
    if out:
        yield shown()


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``fault``: blank, duplicate, truncated or null; a conversation's rows in one partition."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    filled = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text")).repartition("conv_id")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    earlier = Window.partitionBy("conv_id", "_same").orderBy(F.col("turn").asc_nulls_first())
    marked = filled.withColumn("_same", same).withColumn("_nth", F.row_number().over(earlier))
    fault = F.when(~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), "blank").when(F.col("_nth") > 1, "duplicate").when(~F.rlike("text", F.lit(rf"[.!?]{SPACE}*\z")), "truncated")
    return marked.select("conv_id", "turn", "role", "text", fault.alias("fault"), "_nth")


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation of rows (conv_id, turn, role, text), in order within a partition.

    conv_id, turn, edit, was (the row's own role), fault, and role and text as repaired: null where deleted. An inserted
    row has no turn and no own role.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_nth"]
    schema = "conv_id long, turn long, edit string, was string, fault string, role string, text string"
    return faults(rows).sortWithinPartitions(*order).drop("_nth").mapInArrow(_edited, schema)


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
DIGEST = f"conv_id long, {' long, '.join(FIGURES)} long, audit string, repaired_sha256 string"


class _Digest:
    """The figures of one conversation, from its edits in order."""

    def __init__(self, conv: int | None):
        self.conv, self.first, self.last, self.turns = conv, None, None, 0
        self.count, self.illegal, self.cost = dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0
        self.was, self.audit, self.hash, self.any = None, [], hashlib.sha256(), False

    def add(self, turn, edit, was, fault, role, text) -> None:
        self.audit.append(edit)
        self.cost += {KEEP: 0, REROLE: REROLED, DELETE: DELETED, INSERT: INSERTED}[edit]
        if edit != INSERT:
            if turn is not None and turn != self.last:
                self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
            if fault:
                self.count[fault] += 1
            if fault == "truncated" and edit != DELETE:
                self.cost += CUT_OFF
            if self.was is not None:
                self.illegal += self.was[:1] + was[:1] not in ("su", "ua", "au")
            self.was = was
        if edit != DELETE:
            self.hash.update(f"{chr(10) * self.any}{role}:{text}".encode())
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv, gaps if gaps < 2**63 else None, *self.count.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


@memo.task()
def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *((f, pa.int64()) for f in FIGURES), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    now, out = None, []
    shown = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now.conv:
                if now:
                    out.append(now.row())
                now = _Digest(conv)
            now.add(*row)
        if out:
            yield shown()
            out.clear()
    if now:
        out.append(now.row())
        yield shown()


def digest(edits: DataFrame) -> DataFrame:
    """One row a conversation: its figures, its edits as one string, and the hash of what is left."""
    # no exchange in between: a conversation's edits come in order
    return edits.mapInArrow(_digested, DIGEST)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with a known share of faults, decided by conversation and turn: dropped, emptied, cut off, repeated, given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), times.alias("_times"))
    return out.filter("_times > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_times", "_copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of every conversation after its rows are damaged."""
    rows = table(spark, sf_dir, "conversations")
    found = digest(repair(damaged(rows)))
    every = rows.select(F.col("conv_id").cast("long").alias("_conv")).distinct()
    none = {**dict.fromkeys(FIGURES, 0), "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    held = F.col("repaired_sha256").isNotNull()
    out = every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("_conv").alias("conv_id"), *(F.when(held, F.col(c)).otherwise(F.lit(v).cast("long") if c in FIGURES else F.lit(v)).alias(c) for c, v in none.items()))
