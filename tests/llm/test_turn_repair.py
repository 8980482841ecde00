"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import zlib

import pytest

from areapulse.llm import turn_repair
from areapulse.llm.turn_repair import Conversation, Steps, damaged, repair_report, repaired_turns

SPACES = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
LEGAL = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def cheapest(rows):
    """(cost, audit, repaired turns) by Dijkstra's search over (rows used, last role initial)."""
    seen, facts = set(), []
    for role, text in rows:
        said, again = text.rstrip(SPACES), (role, text) in seen
        seen.add((role, text))
        facts.append((role[:1], not said or again, bool(said) and not again and said[-1] not in ".!?"))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(out)
        if (i, last) in done:
            continue
        done.add((i, last))
        to = NEXT[last]
        name = {"u": "user", "a": "assistant"}[to]
        heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*out, (name, ""))))
        if i < len(rows):
            initial, goes, cut = facts[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if not goes:
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, to, (*out, (name, rows[i][1]))))
                if (last, initial) in LEGAL:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, initial, (*out, rows[i])))


def repaired(rows, steps, memory_bytes=1 << 20):
    conv = Conversation("k", steps, memory_bytes)
    for i, (role, text) in enumerate(rows):
        conv.add(i, True, role, text)
    edits = list(conv.edited())
    return conv.total, "".join(e[0] for e in edits), [e[2:] for e in edits if e[0] != "D"]


def some_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    return [(rng.choice(roles), rng.choice(["", "hi.", "yo", "ok!", " ", f"x{rng.randrange(9)}."])) for _ in range(n)]


def test_cheapest_edits_with_the_least_audit():
    rng, steps = random.Random(5), Steps()
    for _ in range(1500):
        rows = some_rows(rng, rng.choice([0, 1, 2, 3, 5, 9, 40]))
        assert repaired(rows, steps) == cheapest(rows)


def test_spilled_conversation_is_the_same(monkeypatch):
    monkeypatch.setattr(turn_repair, "BLOCK", 7)
    rng, steps = random.Random(6), Steps()
    for n in (6, 7, 8, 14, 50, 200):
        rows = some_rows(rng, n)
        assert repaired(rows, steps, memory_bytes=300) == cheapest(rows)


def test_steps_are_finite():
    rng, steps = random.Random(7), Steps()
    for _ in range(30):
        weights = [rng.random() ** 2 for _ in range(5)]
        conv = Conversation("k", steps, 1 << 30)
        for i in range(3000):
            role = rng.choices(["user", "assistant", "system", "tool", ""], weights)[0]
            conv.add(i, True, role, f"{i}" + rng.choice([".", ""]) if rng.random() < 0.9 else "")
    assert len(steps.made) < 1 << 16


def expected(table):
    """The report by plain code: conv_id -> row."""
    out = {}
    said = lambda x: " " if x is None else str(x)
    for key in {r[0] for r in table}:
        rows = []
        for conv, turn, role, text in (r[:4] for r in table if r[0] == key):
            place = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
            role, text = said(role), said(text)
            text = "" if place == 1 else text.translate(str.maketrans("", "", ".!?")) if place == 2 else text
            role = "user" if place == 4 else role
            rows += [(turn, role, text)] * (0 if place == 0 else 2 if place == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        cost, audit, kept = cheapest([r[1:] for r in rows])
        numbers = {r[0] for r in rows} - {None}
        seen, faults = set(), [0, 0, 0]
        for _, role, text in rows:
            s = text.rstrip(SPACES)
            kind = 0 if not s else 1 if (role, text) in seen else 2 if s[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                faults[kind] += 1
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[key] = (gaps, *faults, illegal, cost, audit, digest)
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(9)):
            rows += [(conv, turn, role, text, "x", 1) for role, text in some_rows(rng, 1)]
    rows += [(200, None, None, None, "x", 1), (200, None, "user", "Hi.", "x", 1), (200, 5, "user", "Hi.", "x", 1), (200, 5, "ai", "é 世.", "x", 1)]
    rows += [(None, t, "user", "a long one. " * 20_000, "x", 1) for t in range(3)]
    rows += [(300, 1, "user", "Same.", "x", 1)] * 40  # repeated rows
    rows += [(400, -(2**62), "user", "Far.", "x", 1), (400, 2**62, "assistant", "Away.", "x", 1)]
    rows += [(2**53 + 1, 2**53 + 1, "user", "Large id.", "x", 1)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, key int").repartition(5)


def test_report(turns):
    frame, alive = damaged(turns)
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in repair_report(frame, alive).collect()}
    assert got == expected([tuple(r) for r in turns.collect()])


def test_batches_and_spills_do_not_matter(spark, turns):
    frame, alive = damaged(turns)
    want = sorted(map(str, repair_report(frame, alive).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, repair_report(frame, alive, memory_bytes=200).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repaired_turns_give_the_hash(turns):
    frame, alive = damaged(turns)
    report = {r.conv_id: r for r in repair_report(frame, alive).collect()}
    said = {}
    for r in sorted(repaired_turns(frame, alive).collect(), key=lambda r: r.position):
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.edit != "I" or (r.turn is None and r.text == "")
    for conv, row in report.items():
        assert hashlib.sha256("\n".join(said.get(conv, [])).encode()).hexdigest() == row.repaired_sha256


def test_empty_table_and_conversation_without_rows(spark, turns):
    assert repair_report(turns.limit(0)).collect() == []
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame, alive = damaged(spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string"))
    (row,) = repair_report(frame, alive).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
