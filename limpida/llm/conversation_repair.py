"""Conversation structure repair by a persistent audit DP (operator 12).

The cheapest edits that give a conversation legal roles are found by dynamic programming over its rows, one cell
for each state of the grammar ``(s?(ua)+)?``: nothing yet, after system, after user, after assistant. A cell holds
its cost and a node of a tree of edits: paths share their prefixes as linked nodes, each with its binary-lifting
ancestors and a rolling hash of the path that leads to it. Of equally cheap paths the ASCII-least wins, which a
search for their longest common prefix decides through ancestors of equal hash; the prefix so found is verified
node by node up to the node that both share. Each cell also holds a running SHA-256 of its repaired text.

A path's cost follows from its letters alone, so of two equally cheap paths to one cell none is a proper prefix of
the other: the least path to a cell stays least whatever follows, and a repaired text follows from its audit.

Rows of a conversation come sorted through one task and are never gathered: a task holds four cells, and the tree is
cut back to the paths still alive, which join after a few rows. The digest of a repaired text can only be taken in
order, so a conversation is one task's stream, however long. Which rows repeat an earlier turn is found before,
on digests of their content; a marker row precedes each of them.

Defined results: damage as in ``damaged``, faults as in ``Conversation.row``, edits as in ``Repair.row``. Nulls in role and text count as one space; a
null turn comes first; rows without conv_id are one conversation. Rows of the same turn are taken by role, then by
the SHA-256 of the text. A role whose first letter is not s, u or a, or that is empty, cannot be kept. Empty and
blank texts are faults; very long ones are streamed. Repeated rows are duplicates. A conversation whose rows are
all dropped has zeros, an empty audit and the digest of the empty string. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpida.llm.words import chunks

#: Costs of edits; Delete is the only edit of blank and duplicate rows, an undeleted truncated row costs one more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant; the first and the last may end a conversation.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = frozenset({"su", "ua", "au"})

#: Nodes of a tree from which it is cut back to the living paths.
CUT_FROM = 4096
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A4C68E2
_BLANKS = " \t\n\v\f\r"


class Edits:
    """A tree of edit letters: each path from the root is a string that shares its prefixes with others."""

    def __init__(self) -> None:
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[0]]

    def add(self, parent: int, letter: str) -> int:
        """The path of ``parent`` with one more letter."""
        node = len(self.letter)
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(letter)) % _PRIME)
        above = [parent]
        while above[-1] and len(self.up[above[-1]]) >= len(above):
            above.append(self.up[above[-1]][len(above) - 1])
        self.up.append(above)
        return node

    def ancestor(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps >>= 1
            k += 1
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether the path to ``a`` is before that to ``b``, by their longest common prefix."""
        depth_a, depth_b = self.depth[a], self.depth[b]
        both = min(depth_a, depth_b)
        x, y = self.ancestor(a, depth_a - both), self.ancestor(b, depth_b - both)
        if self.hash[x] != self.hash[y]:
            for k in range(both.bit_length(), -1, -1):
                if 1 << k <= self.depth[x]:
                    p, q = self.up[x][k], self.up[y][k]
                    if self.hash[p] != self.hash[q]:
                        x, y = p, q
            if self.same(self.up[x][0], self.up[y][0]):
                return self.letter[x] < self.letter[y]
        elif self.same(x, y):
            return depth_a < depth_b
        return self.text(a) < self.text(b)

    def same(self, x: int, y: int) -> bool:
        """Whether two paths of one length and one hash are equal, letter by letter up to the node they share."""
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def text(self, node: int, above: int = 0) -> str:
        """The letters after ``above`` (the root) up to ``node``."""
        out = []
        while node != above:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def shared(self, nodes: list[int]) -> int:
        """The deepest node that all paths have in common."""
        nodes = set(nodes)
        while len(nodes) > 1:
            deepest = max(nodes, key=self.depth.__getitem__)
            nodes.remove(deepest)
            nodes.add(self.up[deepest][0])
        return nodes.pop()

    def cut_back(self, alive: list[int]) -> tuple[str, Edits, list[int]]:
        """What all living paths begin with, and a tree of what follows, with the paths' nodes in it."""
        fork = self.shared(alive)
        tree, moved = Edits(), {fork: 0}
        for node in alive:
            path = []
            while node not in moved:
                path.append(node)
                node = self.up[node][0]
            at = moved[node]
            for node in reversed(path):
                at = moved[node] = tree.add(at, self.letter[node])
        return self.text(fork), tree, [moved[node] for node in alive]


@dataclass
class Cell:
    """The best way to a state: cost, node of the edits, digest of the repaired text, whether it has rows."""

    cost: int
    node: int
    digest: object
    any: bool


class Repair:
    """The DP of one conversation, row by row."""

    def __init__(self) -> None:
        self.edits, self.settled, self.limit = Edits(), [], CUT_FROM
        self.cells: list[Cell | None] = [Cell(0, 0, hashlib.sha256(), False), None, None, None]
        self._insert()

    def _better(self, best, cost: int, start: Cell, letter: str, said: bytes | None):
        """The better of two moves (cost, node, cell it starts from, what it adds)."""
        if best is not None and best[0] < cost:
            return best
        node = self.edits.add(start.node, letter)
        if best is None or cost < best[0] or self.edits.less(node, best[1]):
            return cost, node, start, said
        return best

    @staticmethod
    def _cell(move) -> Cell:
        cost, node, start, said = move
        if said is None:
            return Cell(cost, node, start.digest, start.any)
        digest = start.digest.copy()
        digest.update(b"\n" + said if start.any else said)
        return Cell(cost, node, digest, True)

    def _insert(self) -> None:
        """Insert turns: a user turn where one may follow, then an assistant turn."""
        for letter, to, starts in (("u", USER, (EMPTY, SYSTEM, ASSISTANT)), ("a", ASSISTANT, (USER,))):
            now = self.cells[to]
            best = None
            for s in starts:
                start = self.cells[s]
                if start is None or now is not None and now.cost < start.cost + INSERT:
                    continue
                best = self._better(best, start.cost + INSERT, start, "I", f"{NAMES[letter]}:".encode())
            if best is not None and (now is None or best[0] < now.cost or self.edits.less(best[1], now.node)):
                self.cells[to] = self._cell(best)

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        moves: list = [None] * 4
        for state, start in enumerate(self.cells):
            if start is None:
                continue
            moves[state] = self._better(moves[state], start.cost + DELETE, start, "D", None)
            if must_go:
                continue
            more = TRUNCATED if truncated else 0
            to = NEXT[state].get(role[:1])
            if to is not None:
                moves[to] = self._better(moves[to], start.cost + KEEP + more, start, "K", f"{role}:{text}".encode("utf-8", "surrogatepass"))
            for letter, name in NAMES.items():
                to = NEXT[state].get(letter)
                if to is not None:
                    moves[to] = self._better(moves[to], start.cost + REROLE + more, start, "R", f"{name}:{text}".encode("utf-8", "surrogatepass"))
        self.cells = [None if m is None else self._cell(m) for m in moves]
        self._insert()
        # After an assistant all can follow that can after nothing or system, but for a kept system row.
        for state, ahead in ((EMPTY, DELETE), (SYSTEM, 0)):
            if self.cells[state] is not None and self.cells[state].cost > self.cells[ASSISTANT].cost + ahead:
                self.cells[state] = None
        if len(self.edits.letter) > self.limit:
            alive = [c for c in self.cells if c is not None]
            done, self.edits, nodes = self.edits.cut_back([c.node for c in alive])
            self.settled.append(done)
            for cell, node in zip(alive, nodes, strict=True):
                cell.node = node
            self.limit = max(CUT_FROM, 2 * len(self.edits.letter))

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest repaired conversation."""
        ends = [c for c in (self.cells[EMPTY], self.cells[ASSISTANT]) if c is not None]
        best = ends[0]
        for cell in ends[1:]:
            if cell.cost < best.cost or cell.cost == best.cost and self.edits.less(cell.node, best.node):
                best = cell
        return best.cost, "".join(self.settled) + self.edits.text(best.node), best.digest.hexdigest()


class Conversation:
    """Counts of faults and the repair of one conversation, from its rows in order."""

    def __init__(self) -> None:
        self.repair = Repair()
        self.low = self.high = self.turn = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def row(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        end = text.rstrip(_BLANKS)[-1:]
        blank = not end
        duplicate = not blank and seen
        truncated = not blank and not duplicate and end not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.last is not None:
            self.illegal += self.last + role[:1] not in LEGAL_PAIRS
        self.last = role[:1]
        self.repair.row(role, text, blank or duplicate, truncated)

    def result(self) -> tuple:
        cost, audit, digest = self.repair.result()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = ["conv_id", *(f.split()[0] for f in FIELDS.split(", "))]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, from its rows and markers in order."""
    name = talk = before = marked = kind = None
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _NAMES)

    for whole in batches:
        kind = whole.schema.field("conv_id").type
        for batch in chunks(iter([whole]), "text"):
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "copies", "text"))
            for conv, turn, role, digest, copies, text in zip(*columns, strict=True):
                if talk is None or conv != name:
                    if talk is not None:
                        done.append((name, *talk.result()))
                    name, talk, before, marked = conv, Conversation(), None, None
                    if len(done) >= 1000:
                        yield out()
                        done.clear()
                what = turn, role, digest
                if copies is None:
                    marked = what
                for _ in range(copies or 0):
                    talk.row(turn, role, text, what in (marked, before))
                    before = what
    if talk is not None:
        done.append((name, *talk.result()))
        yield out()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped) of each row, damaged by crc32 of ``conv_id:turn`` modulo 20."""

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(plain("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Every conv_id of ``rows`` (conv_id, turn, role, text, copies) with its faults, cheapest edits and digest."""
    rows = rows.withColumn("digest", F.sha2("text", 256))
    there = rows.where("copies > 0").select("conv_id", "turn", "role", "digest").distinct()
    content = ["conv_id", "role", "digest"]
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = there.groupBy(*content).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    first = first.select(*(F.col(c).alias(f"__{c}") for c in content), F.col("first.turn").alias("__turn"))
    again = F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest"))
    later = there.join(first, again & ~F.col("turn").eqNullSafe(F.col("__turn"))).select("conv_id", "turn", "role", "digest")
    later = later.withColumns({"copies": F.lit(None).cast("int"), "text": F.lit(None).cast("string")})
    order = ["conv_id", "turn", "role", "digest", "copies"]
    met = rows.select(*order, "text").unionByName(later).repartition("conv_id").sortWithinPartitions(*order)
    return met.mapInArrow(_repaired, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {FIELDS}")
