"""Conversation repair against a search over all edit sequences, and the tree of edits against strings."""

import hashlib
import random
import re
import zlib

import pytest

from limpida.llm import conversation_repair as cr

BLANK = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, digest STRING, copies STRING, block STRING"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
        role, text = show[2:]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = BLANK.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cheapest (cost, audit, repaired) by a plain search that keeps whole strings."""
    marks = faults(rows)
    best = {}
    heap = [(0, "", 0, "", "")]
    import heapq

    while heap:
        cost, audit, at, roles, said = heapq.heappop(heap)
        if at == len(rows) and LEGAL.fullmatch(roles):
            return cost, audit, said[1:]
        state = at, roles[-1:] or "-"
        if best.get(state, (cost, audit)) < (cost, audit):
            continue
        best[state] = cost, audit

        def go(more, letter, step, role, text, cost=cost, audit=audit, at=at, roles=roles, said=said):
            new = roles + role[:1]
            if role and not re.fullmatch(r"s?(ua)*u?", new):
                return
            heapq.heappush(heap, (cost + more, audit + letter, at + step, new, said + (f"\n{role}:{text}" if role else "")))

        for role in ("user", "assistant"):
            go(2, "I", 0, role, "")
        if at < len(rows):
            _, _, role, text = rows[at]
            go(3, "D", 1, "", "")
            if marks[at] not in ("blank", "duplicate"):
                more = marks[at] == "truncated"
                if role[:1] in ("s", "u", "a"):
                    go(more, "K", 1, role, text)
                for other in ("user", "assistant"):
                    go(2 + more, "R", 1, other, text)


def expected(table):
    want = {}
    for conv in {r[0] for r in table}:
        rows = plain_damage([r for r in table if r[0] == conv])
        marks = faults(rows)
        turns = {r[1] for r in rows if r[1] is not None}
        cost, audit, said = plain_repair(rows)
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
        want[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(marks.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256(said.encode()).hexdigest(),
        )
    return want


def random_table(seed, n):
    pick = random.Random(seed)
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "ugly"]
    texts = ["Hi.", "Well?", "no end", "", " \t\n", None, "Été!", "😀", "a\nb. ", "x" * 50 + "."]
    return [(conv, pick.choice([*range(6), None]), pick.choice(roles), pick.choice(texts)) for conv in [None, *range(n)] for _ in range(pick.randint(1, 7))]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_plain_search(spark, seed):
    table = random_table(seed, 150)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in table], SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair_conversations(cr.damaged(df)).collect()}
    assert got == expected(table)


def test_long_conversation_is_cut_back(spark, monkeypatch):
    pick = random.Random(3)
    table = [(7, n, pick.choice(["user", "assistant", "tool"]), f"text {n}" + pick.choice([".", ""])) for n in range(3000)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in table], SCHEMA)
    rows = plain_damage(table)
    talk = cr.Conversation()
    monkeypatch.setattr(cr, "CUT_FROM", 10**9)
    whole = cr.Repair()
    seen = set()
    most = 0
    for (_, turn, role, text), mark in zip(rows, faults(rows), strict=True):
        whole.row(role, text, mark in ("blank", "duplicate"), mark == "truncated")
        talk.repair.limit = min(talk.repair.limit, 200)
        cr.CUT_FROM = 200
        talk.row(turn, role, text, (role, text) in seen)
        cr.CUT_FROM = 10**9
        seen.add((role, text))
        most = max(most, len(talk.repair.edits.letter))
    monkeypatch.undo()
    row = cr.repair_conversations(cr.damaged(df)).first()
    assert (row.cost, row.audit, row.repaired_sha256) == whole.result() == talk.result()[-3:]
    assert most < 500 < len(whole.edits.letter)


def test_edits_compare_like_strings(monkeypatch):
    pick = random.Random(4)
    for base in (cr._BASE, 0):  # with base 0 the hash is that of the last letter alone, so that hashes collide
        monkeypatch.setattr(cr, "_BASE", base)
        tree = cr.Edits()
        said = [""]
        for _ in range(400):
            parent = pick.randrange(max(0, len(said) - 30), len(said))
            letter = pick.choice("DIKR" if base else "DK")
            assert tree.add(parent, letter) == len(said)
            said.append(said[parent] + letter)
        for _ in range(4000):
            a, b = pick.randrange(len(said)), pick.randrange(len(said))
            assert tree.less(a, b) == (said[a] < said[b]) and tree.text(a) == said[a]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cr.repair_conversations(cr.damaged(none)).isEmpty()
    gone = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    row = cr.repair_conversations(cr.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.", "", "", "")], SCHEMA))).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
