"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from corpus_spark.llm import repair
from corpus_spark.llm.queries import op12_conversation_repair

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    found, seen = [], set()
    for role, text in rows:
        own = re.findall(r"[^\x20\x09-\x0D]", text)
        found.append("blank" if not own else "duplicate" if (role, text) in seen else None if own[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest(rows):
    """(cost, audit, lines) by taking the cheapest and first unfinished audit until one is finished."""
    wrong = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, place, initials, lines = heapq.heappop(heap)
        if place == len(rows) and GRAMMAR.match(initials):
            return cost, audit, "\n".join(lines)
        key = (place, initials[-1:], initials == "s")
        if key in done:
            continue
        done.add(key)

        def go(more, letter, step, line=None, initial=None, cost=cost, audit=audit, place=place, initials=initials, lines=lines):
            joined = initials + ("" if line is None else initial)
            if GRAMMAR.match(joined) or GRAMMAR.match(joined + "a") or GRAMMAR.match(joined + "ua"):
                heapq.heappush(heap, (cost + more, audit + letter, place + step, joined, lines if line is None else (*lines, line)))

        for name in ("user", "assistant"):
            go(2, "I", 0, f"{name}:", name[0])
        if place < len(rows):
            (role, text), fault = rows[place], wrong[place]
            go(3, "D", 1)
            if fault not in ("blank", "duplicate"):
                if role:
                    go(fault == "truncated", "K", 1, f"{role}:{text}", role[0])
                for name in ("user", "assistant"):
                    go(2 + (fault == "truncated"), "R", 1, f"{name}:{text}", name[0])
    raise AssertionError


def plain(table):
    """Rows of the operator from (conv_id, turn, role, text)."""
    found = []
    for conv in {row[0] for row in table}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in table if c == conv]
        own.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1], hashlib.md5(row[2].encode()).hexdigest()))
        turns = {t for t, _, _ in own if t is not None}
        rows = [(role, text) for _, role, text in own]
        wrong = faults(rows)
        cost, audit, lines = cheapest(rows)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found.append((conv, gaps, *map(wrong.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(found, key=repr)


def some_rows(seed, n, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Users"])
            text = rng.choice(["Hello.", "Yes!", "cut short", "", " \t", None, "Why?", "“quote”", "a\nb.", "é."])
            rows.append((conv, rng.choice([None, *range(-3, 12)]), role, text))
    return rows


@pytest.mark.parametrize("piece", [1, 3, 4096])
def test_repair_equals_a_search(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    rows = some_rows(piece, 60) + [(200, t, random.Random(t).choice(["user", "assistant", "system"]), f"Turn {t % 9}{'.' if t % 4 else ''}") for t in range(70)]
    rows += [(201, 5, "user", "Same.")] * 9 + [(202, None, "user", "Hi.")] + [(203, 2**62, "user", "Far."), (203, -(2**62), "assistant", "Off.")]
    df = spark.createDataFrame([(*row, 1) for row in rows], "conv_id long, turn long, role string, text string, Audit int").repartition(5)
    got = [tuple(row) for row in repair.repair(df).collect()]
    assert sorted(got, key=repr) == plain(rows)
    assert repair.repair(df.limit(0)).count() == 0
    turns = repair.repaired_turns(df).collect()
    lines = {}
    for row in sorted(turns, key=lambda row: row.place):
        lines.setdefault(row.conv_id, []).append(f"{row.role}:{row.text}")
    for conv, *_, audit, digest in got:
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == digest
        assert sorted(row.edit for row in turns if row.conv_id == conv) == sorted(letter for letter in audit if letter != "D")


def test_audits_compare_as_texts(monkeypatch):
    rng = random.Random(3)

    def check():
        nodes = [repair.Audit()]
        for _ in range(400):
            nodes.append(repair.Audit(rng.choice(["D", "I", "K", "R", "", "DK", "D" * 5]), rng.choice(nodes[-30:])))
        for _ in range(3000):
            a, b = rng.choices(nodes, k=2)
            assert repair.before(a, b) == (a.text() < b.text())

    check()
    # Collisions of the hashes are found out: with few hashes most of them collide.
    monkeypatch.setattr(repair, "_PRIME", 3)
    check()


def test_ids_of_any_type(spark):
    rows = [("x", 1, "user", "Hi."), ("x", 2, "assistant", "Ho."), (None, 1, "system", "Be."), ("", 1, "assistant", "cut")]
    found = repair.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()
    assert sorted(map(tuple, found), key=repr) == plain(rows)


def test_query_equals_plain(spark, small_dir):
    def check(folder):
        read = [tuple(row) for row in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        rows = []
        for conv, turn, role, text in read:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        lost = {row[0] for row in read} - {row[0] for row in rows}
        want = plain(rows) + [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv in lost]
        assert sorted(map(tuple, op12_conversation_repair(spark, folder).collect())) == sorted(want)
        return want

    assert any(row[6] for row in check(small_dir))
    check(small_dir.replace("sf0.001", "sf0.01"))
