"""Repair of the turn structure of conversations by cheapest edits, streamed through secondary-sorted partitions.

Turns are dealt out by conversation and sorted by turn; a task walks its sorted Arrow batches once and carries the state of a
dynamic program across them. Wanted is a role sequence ``(s?(ua)+)?``. Its automaton has four states, and what the program
knows after a turn - the cost of the best edits into each state and the order of their edit strings - takes few different
values, so each step is one look-up in a table that grows as it is used. A turn leaves one 16-bit backpointer, the number of
its step. When a conversation ends, the backpointers are walked back and its turns are read forward once more, to be written
or hashed. A conversation of any size takes bounded memory: beyond ``memory_bytes`` its turns, beyond ``BLOCK`` its
backpointers and seen-before digests go to scratch files of the task, which a repeated task writes anew.

One conversation is one task, since its edits and the hash of its text depend on all turns before; a conversation that holds a
third of all rows is streamed, never gathered.

Defined cases: a null role or text counts as one space; nulls of ``turn`` come first and are in no gap; turns of one number are
ordered by role and text; rows of a null conversation id form one conversation; a role that does not begin with s, u or a (an
empty one included) cannot stay as it is; a conversation without live rows has zeros and an empty audit; very long texts are
hashed as they pass; an empty table has no rows. Columns are picked by name, so others may clash with results.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapulse.llm.common import SPACES

#: Entries held in memory before a block of them is spilled.
BLOCK = 1 << 19
_FAR = 1 << 30

# Automaton of (s?(ua)+)?: start, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# The only turn that may be inserted in, or that a role may be changed to in, each state.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_INITIALS = {"s", "u", "a"}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
# Whatever can follow a state can follow any other for at most two insertions and the deletion of a system turn more, so a
# state dearer by more than that is never on the way to the cheapest end. This keeps the number of steps finite.
SLACK = 2 * INSERT + DELETE


@dataclass(frozen=True)
class Knowledge:
    """Cost into each state above the cheapest, and the order of the edit strings that lead there."""

    costs: tuple[int, ...]
    order: tuple[int, ...]


@dataclass(frozen=True)
class Step:
    """One turn: what is known after it, what the cheapest state costs more, and where each state came from by which edits."""

    after: Knowledge
    dearer: int
    source: tuple[int, ...]
    edits: tuple[str, ...]


@dataclass
class Steps:
    """Steps met so far, numbered."""

    numbers: dict[tuple[Knowledge, str, bool, bool], int] = field(default_factory=dict)
    made: list[Step] = field(default_factory=list)

    def number(self, known: Knowledge, initial: str, goes: bool, cut: bool) -> int:
        key = (known, initial, goes, cut)
        n = self.numbers.get(key)
        if n is None:
            n = self.numbers[key] = len(self.made)
            self.made.append(_step(*key))
        return n


def _inserted(state: int, n: int) -> int:
    for _ in range(n):
        state = _NEXT[state]
    return state


def _step(known: Knowledge, initial: str, goes: bool, cut: bool) -> Step:
    """Insertions before a turn, then its own edit. All edit strings of as many turns are prefix-free, so the order of two
    strings is the order of their first parts, and of the new parts only where those are the same."""
    best: dict[int, tuple[int, int, str, int]] = {}
    for state in (q for q in range(4) if known.costs[q] < _FAR):
        for n in range(3):
            at, cost = _inserted(state, n), known.costs[state] + n * INSERT
            moves = [(at, cost + DELETE, "D")]
            if not goes:
                moves.append((_NEXT[at], cost + REROLE + cut * CUT, "R"))
                if (at, initial) in _AFTER:
                    moves.append((_AFTER[at, initial], cost + KEEP + cut * CUT, "K"))
            for to, total, edit in moves:
                found = (total, known.order[state], "I" * n + edit, state)
                best[to] = min(best.get(to, found), found)
    low = min(b[0] for b in best.values())
    best = {q: b for q, b in best.items() if b[0] <= low + SLACK}
    ranks = sorted(best, key=lambda q: best[q][1:3])
    after = Knowledge(
        tuple(best[q][0] - low if q in best else _FAR for q in range(4)), tuple(ranks.index(q) if q in best else 4 for q in range(4))
    )
    return Step(after, low, tuple(best[q][3] if q in best else -1 for q in range(4)), tuple(best[q][2] if q in best else "" for q in range(4)))


FIRST = Knowledge((0, _FAR, _FAR, _FAR), (0, 4, 4, 4))


def _last(known: Knowledge) -> tuple[int, int, str]:
    """Cost above the cheapest, state before and insertions of the cheapest end."""
    ends = [
        (known.costs[q] + n * INSERT, known.order[q], "I" * n, q)
        for q in range(4)
        for n in range(3)
        if known.costs[q] < _FAR and _inserted(q, n) in (START, ASSISTANT)
    ]
    cost, _, edits, state = min(ends)
    return cost, state, edits


class Seen:
    """Digests met before. Beyond ``BLOCK`` they lie in 256 sorted scratch files by their first byte."""

    def __init__(self) -> None:
        self.recent: set[bytes] = set()
        self.parts: dict[int, np.ndarray] = {}

    def meet(self, digest: bytes) -> bool:
        """True if met before; it is from now on."""
        if digest in self.recent:
            return True
        part = self.parts.get(digest[0])
        if part is not None:
            key = np.void(digest)
            at = int(np.searchsorted(part.view("S16"), np.frombuffer(digest, "S16")[0]))
            if at < len(part) and part[at] == key:
                return True
        self.recent.add(digest)
        if len(self.recent) >= BLOCK:
            self._flush()
        return False

    def _flush(self) -> None:
        fresh: dict[int, list[bytes]] = {}
        for d in self.recent:
            fresh.setdefault(d[0], []).append(d)
        for first, digests in fresh.items():
            rows = np.frombuffer(b"".join(digests), "V16")
            old = self.parts.get(first)
            rows = rows if old is None else np.concatenate([np.asarray(old), rows])
            file = tempfile.TemporaryFile()
            np.sort(rows.view("S16")).tofile(file)
            file.flush()
            self.parts[first] = np.memmap(file, "V16", "r")
        self.recent = set()


class Spool:
    """Turns in order; beyond a number of bytes they go to a scratch file in blocks."""

    def __init__(self, memory_bytes: int) -> None:
        self.memory_bytes, self.size = memory_bytes, 0
        self.rows: list[tuple] = []
        self.file = None

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.size += size
        if self.size >= self.memory_bytes:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.rows, self.file, pickle.HIGHEST_PROTOCOL)
            self.rows, self.size = [], 0

    def __iter__(self) -> Iterator[tuple]:
        if self.file is not None:
            self.file.seek(0)
            try:
                while True:
                    yield from pickle.load(self.file)
            except EOFError:
                pass
        yield from self.rows


class Backpointers:
    """One 16-bit number a turn, in blocks; full blocks lie in a scratch file."""

    def __init__(self) -> None:
        self.open, self.blocks, self.file = array("H"), 0, None

    def add(self, n: int) -> None:
        self.open.append(n)
        if len(self.open) == BLOCK:
            self.file = self.file or tempfile.TemporaryFile()
            self.open.tofile(self.file)
            self.open, self.blocks = array("H"), self.blocks + 1

    def _block(self, i: int) -> array:
        if i == self.blocks:
            return self.open
        self.file.seek(i * BLOCK * 2)
        read = array("H")
        read.fromfile(self.file, BLOCK)
        return read

    def walk(self, steps: list[Step], state: int) -> Iterator[tuple[int, int]]:
        """(step, state after it) of every turn, first turn first: back over the blocks once for their last states, then on."""
        ends = [state]
        for i in range(self.blocks, 0, -1):
            for n in reversed(self._block(i)):
                state = steps[n].source[state]
            ends.append(state)
        for i, end in zip(range(self.blocks + 1), reversed(ends)):
            path = []
            for n in reversed(self._block(i)):
                path.append((n, end))
                end = steps[n].source[end]
            yield from reversed(path)


class Conversation:
    """What is carried of one conversation from batch to batch."""

    def __init__(self, key: str | None, steps: Steps, memory_bytes: int) -> None:
        self.key, self.steps = key, steps
        self.spool, self.back, self.seen = Spool(memory_bytes), Backpointers(), Seen()
        self.known, self.cost, self.rows = FIRST, 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.last_turn = None
        self.turns = 0
        self.initial: str | None = None

    def add(self, turn: int, numbered: bool, role: str, text: str) -> None:
        if numbered and turn != self.last_turn:
            self.low, self.high, self.last_turn = turn if self.low is None else self.low, turn, turn
            self.turns += 1
        initial = role[:1]
        if self.rows and (self.initial, initial) not in _LEGAL:
            self.illegal += 1
        self.initial, self.rows = initial, self.rows + 1
        said = text.rstrip(SPACES)
        raw = f"{len(role)}:{role}{text}".encode()
        repeated = self.seen.meet(hashlib.blake2b(raw, digest_size=16).digest())
        goes, cut = not said or repeated, False
        if not said:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif said[-1] not in ".!?":
            self.truncated, cut = self.truncated + 1, True
        n = self.steps.number(self.known, initial if initial in _INITIALS else "", goes, cut)
        step = self.steps.made[n]
        self.known, self.cost = step.after, self.cost + step.dearer
        self.back.add(n)
        self.spool.add((turn if numbered else None, role, text), len(raw) + 200)

    def edited(self) -> Iterator[tuple[str, int | None, str, str]]:
        """(edit, turn, role, text) in order; a deleted turn has its own role and text, an inserted one no turn and no text."""
        dearer, state, ending = _last(self.known)
        self.total = self.cost + dearer
        made = self.steps.made
        for (turn, role, text), (n, after) in zip(self.spool, self.back.walk(made, state)):
            at = made[n].source[after]
            for edit in made[n].edits[after]:
                if edit == "I":
                    at = _NEXT[at]
                    yield "I", None, _NAMES[at], ""
                else:
                    yield edit, turn, _NAMES[_NEXT[at]] if edit == "R" else role, text
        for _ in ending:
            state = _NEXT[state]
            yield "I", None, _NAMES[state], ""

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)


REPORT = "conv_id string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "conv_id string, position bigint, turn bigint, role string, text string, edit string"


def _reported(conv: Conversation) -> Iterator[tuple]:
    digest, audit, first = hashlib.sha256(), [], True
    for edit, _, role, text in conv.edited():
        audit.append(edit)
        if edit != "D":
            digest.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode())
            first = False
    yield conv.key, conv.gaps(), conv.blank, conv.duplicate, conv.truncated, conv.illegal, conv.total, "".join(audit), digest.hexdigest()


def _repaired(conv: Conversation) -> Iterator[tuple]:
    kept = (row for row in conv.edited() if row[0] != "D")
    for position, (edit, turn, role, text) in enumerate(kept):
        yield conv.key, position, turn, role, text, edit


def _walker(
    finish: Callable[[Conversation], Iterator[tuple]], names: list[str], memory_bytes: int
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def frame(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=names)
        return made.astype({"turn": "Int64"}) if "turn" in names else made

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, conv, out, size = Steps(), None, [], 0

        def ended(conv: Conversation) -> Iterator[pd.DataFrame]:
            nonlocal out, size
            for row in finish(conv):
                out.append(row)
                size += sum(len(x) for x in row if isinstance(x, str)) + 100
                if size >= memory_bytes:
                    yield frame(out)
                    out, size = [], 0

        for batch in batches:
            columns = (batch[c].tolist() for c in ("key", "alive", "turn", "numbered", "role", "text"))
            for key, alive, turn, numbered, role, text in zip(*columns):
                if conv is None or key != conv.key:
                    if conv is not None:
                        yield from ended(conv)
                    conv = Conversation(key, steps, memory_bytes)
                if alive:
                    conv.add(turn, numbered, role, text)
        if conv is not None:
            yield from ended(conv)
        yield frame(out)

    return run


def _sorted(turns: DataFrame, alive: Column | None) -> DataFrame:
    live = F.lit(True) if alive is None else F.coalesce(alive, F.lit(False))
    value = lambda c: F.when(live, F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise("")
    rows = turns.select(
        F.col("conv_id").cast("string").alias("key"),
        live.alias("alive"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        F.col("turn").isNotNull().alias("numbered"),
        value("role").alias("role"),
        value("text").alias("text"),
    )
    # A null turn is not numbered, and false sorts first.
    return rows.repartition("key").sortWithinPartitions("key", "numbered", "turn", "role", "text")


def _run(turns: DataFrame, alive: Column | None, finish: Callable, schema: str, memory_bytes: int) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    made = _sorted(turns, alive).mapInPandas(_walker(finish, names, memory_bytes), schema)
    return made.withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType))


def repair_report(turns: DataFrame, alive: Column | None = None, memory_bytes: int = 16 << 20) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): its faults, and the cost, edits and hash of its repair.

    ``alive`` is false for rows that only name their conversation. ``repaired_sha256`` is over ``role:text`` of the repaired
    turns, joined by line breaks.
    """
    return _run(turns, alive, _reported, REPORT, memory_bytes)


def repaired_turns(turns: DataFrame, alive: Column | None = None, memory_bytes: int = 16 << 20) -> DataFrame:
    """The repaired turns: ``conv_id, position, turn, role, text, edit`` (Keep, Rerole, Insert; a turn inserted has no number)."""
    return _run(turns, alive, _repaired, TURNS, memory_bytes)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Turns with faults planted by a hash of their place, and which of them are alive: a way to test repairs.

    Of 20 places one loses its turn, one its text, one its end marks, one is said twice, and one is given to the user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    place = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", place.alias("_place"), said("role").alias("role"), said("text").alias("text"))
    text = F.when(F.col("_place") == 1, "").when(F.col("_place") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"role": F.when(F.col("_place") == 4, "user").otherwise(F.col("role")), "text": text})
    times = F.when(F.col("_place") == 3, 2).otherwise(1)
    return rows.withColumn("_again", F.explode(F.array_repeat(F.lit(0), times))), F.col("_place") != 0
