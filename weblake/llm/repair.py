"""Conversation structure repair by Knuth's lightest-derivation agenda.

A repaired conversation has role initials ``(s?(ua)+)?``. Edits and what they cost: Keep 0, Rerole to user
or assistant 3, Delete 4 (a blank or duplicate turn must go), Insert an empty turn of either 3; a truncated turn
that stays adds 3. Of the cheapest repairs the one with the ASCII-least audit (the initials of its edits) counts.

* A deduction says: from entry state ``p`` the first ``i`` turns can be edited so that what is written ends
  in state ``q``. Its weight is (cost, audit). Edits are hyperedges with one premise; two neighbouring
  blocks of turns make a hyperedge with two. Weights only grow along both, and of two audits of one
  item with equal cost none begins the other (the surplus letters would be inserts, which cost), so both functions are
  superior and monotone: the agenda pops every item at its least weight, and stops when its goals are final.
* Turns are range-partitioned by their place in their conversation, so one of any length is spread over
  tasks, as codes without texts. A task's conversations that lie wholly inside it are finished there; of the
  first and the last one it gives the lightest weights from every entry to every exit state, which are
  joined per conversation. Long runs are taken in blocks of ``BLOCK`` turns that are joined as a balanced tree.
* Equal turns (same place, role and text) are counted first and travel as one row. Duplicates are marked by
  the first place of each (conversation, role, text), aggregated before it is joined.
* Texts meet the audits in one sorted stream per conversation, read row by row. A digest of a whole conversation
  is one sequence by its nature; memory is bounded by the audit.

Defined results: a null role or text is one space; a null conv_id is a conversation of its own; null turns
come first; turns of equal number come in order of role and of the text's SHA-256; equal rows are duplicates; a
conversation without turns needs no repair; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weblake.llm.common import MEMO_WORDS, SLICE_ROWS, map_batches, stage

# States of what is written so far: nothing, after s, after u, after a. The initials each may be followed by.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GOALS = (0, 3)
WRITTEN = {2: "user", 3: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# Turns of a block, the agenda's unit.
BLOCK = 64

_BLANKS = " \t\n\x0b\x0c\r"
_PLACE = ["conv_id", "turn", "role", "digest"]

FRAGMENTS = (
    "conv_id long, open boolean, first_turn long, first_role string, first_digest binary, last_turn long,"
    " first_initial string, last_initial string, turns long, min_turn long, max_turn long,"
    " blank long, duplicate long, truncated long, illegal long,"
    " paths array<struct<entry: int, exit: int, cost: long, audit: string>>"
)
TURNS = "conv_id long, place long, edit string, role string, text string"
DIGESTS = "conv_id long, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns damaged by crc32(``conv_id:turn``) % 20: 0 drops, 1 empties, 2 takes out ``.!?``, 3 repeats, 4 reroles."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    turns = _turns(conversations).withColumn("draw", F.crc32(key) % 20).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1)))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _turns(rows: DataFrame) -> DataFrame:
    filled = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select(*[F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")], *filled)


def _digest():
    return F.unhex(F.sha2("text", 256)).alias("digest")


def _coded(turns: DataFrame) -> DataFrame:
    """One row per place: how many equal turns it holds, and the fault of the first and of the others."""
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    last = F.substring(F.rtrim("text", F.lit(_BLANKS)), -1, 1)
    places = (
        turns.select("conv_id", "turn", "role", _digest(), blank.alias("blank"), (~last.isin(*".!?")).alias("truncated"))
        .groupBy(*_PLACE, "blank", "truncated")
        .agg(F.count("*").alias("copies"))
    )
    same = ["conv_id", "role", "digest"]
    firsts = (
        places.where("not blank")
        .groupBy(*same)
        .agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("f"), F.sum("copies").alias("n"))
        .where("n > 1")
        .select(F.struct(*same).alias("of"), F.col("f.turn").alias("first_turn"), F.lit(True).alias("repeated"))
    )
    joined = places.join(firsts, F.struct(*same).eqNullSafe(F.col("of")), "left")
    later = F.coalesce("repeated", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    fault = F.when(F.col("blank"), "b").when(later, "d").when(F.col("truncated"), "t").otherwise("k")
    return joined.select(*_PLACE, "copies", fault.alias("fault"))


def lightest(codes: str, entry: int, goals: tuple[int, ...], first_only: bool) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) of each goal state after all turns; of the lightest goal alone if ``first_only``.

    ``codes``: two letters a turn, its role's initial (``-``: none of s, u, a) and its fault
    (``k``: none, ``t``: truncated, else it must go).
    """
    n = len(codes) // 2
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    final: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == n and state in goals:
            found[state] = (cost, audit)
            if first_only or len(found) == len(goals):
                return found
        steps = NEXT[state]
        write = 3 if state == 2 else 2
        heapq.heappush(agenda, (cost + INSERT, audit + "I", i, write))
        if i == n:
            continue
        initial, fault = codes[2 * i], codes[2 * i + 1]
        heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, state))
        if fault in "kt":
            stays = cost + (TRUNCATED if fault == "t" else 0)
            if initial in steps:
                heapq.heappush(agenda, (stays, audit + "K", i + 1, steps[initial]))
            heapq.heappush(agenda, (stays + REROLE, audit + "R", i + 1, write))
    return found


Weights = dict[tuple[int, int], tuple[int, str]]


def joined(left: Weights, right: Weights) -> Weights:
    """Lightest weights over two neighbouring runs of turns."""
    out: Weights = {}
    for (p, q), (cost, audit) in left.items():
        for (r, s), (more, rest) in right.items():
            if q == r:
                weight = (cost + more, audit + rest)
                if (p, s) not in out or weight < out[p, s]:
                    out[p, s] = weight
    return out


class Run:
    """Turns of one conversation in their order, kept as the weights of joined blocks of doubling size."""

    memo: dict[tuple[str, bool], Weights] = {}

    def __init__(self, entries: tuple[int, ...]):
        self.entries = entries
        self.tail: list[str] = []
        self.joined: list[tuple[int, Weights]] = []

    def add(self, code: str) -> None:
        self.tail.append(code)
        if len(self.tail) == BLOCK:
            self._push(1, self._weights(range(4)))
            self.tail = []

    def _weights(self, entries, whole: bool = False) -> Weights:
        codes = "".join(self.tail)
        out = self.memo.get((codes, whole))
        if out is None:
            goals = GOALS if whole else (0, 1, 2, 3)
            out = {(p, q): w for p in entries for q, w in lightest(codes, p, goals, whole).items()}
            if len(self.memo) < MEMO_WORDS // 10:
                self.memo[codes, whole] = out
        return out

    def _push(self, size: int, weights: Weights) -> None:
        while self.joined and self.joined[-1][0] == size:
            _, left = self.joined.pop()
            weights, size = joined(left, weights), 2 * size
        self.joined.append((size, weights))

    def weights(self, whole: bool) -> Weights:
        """From the entries to every exit state; of a whole conversation of one block, to its lightest goal only."""
        if whole and not self.joined:
            return self._weights((0,), whole=True)
        out = self._weights(range(4))
        for _, left in reversed(self.joined):
            out = joined(left, out)
        return {(p, q): w for (p, q), w in out.items() if p in self.entries}


class _Fragment:
    """What a task knows of the turns of one conversation."""

    def __init__(self, row: dict, is_open: bool):
        self.out = dict.fromkeys(["blank", "duplicate", "truncated", "illegal", "turns"], 0)
        self.out |= {"conv_id": row["conv_id"], "first_turn": row["turn"], "first_role": row["role"], "first_digest": row["digest"]}
        self.out |= {"min_turn": None, "max_turn": None, "first_initial": row["role"][:1], "open": is_open}
        self.run = Run((0, 1, 2, 3) if is_open else (0,))
        self.initial = None

    def add(self, row: dict) -> None:
        out, turn, initial, fault = self.out, row["turn"], row["role"][:1], row["fault"]
        if turn is not None and turn != out["max_turn"]:
            out["turns"] += 1
            out["max_turn"] = turn
            out["min_turn"] = turn if out["min_turn"] is None else out["min_turn"]
        code = initial if initial in ("s", "u", "a") else "-"
        for _ in range(row["copies"]):
            out["illegal"] += self.initial is not None and not legal(self.initial, initial)
            name = {"b": "blank", "d": "duplicate", "t": "truncated"}.get(fault)
            if name:
                out[name] += 1
            self.run.add(code + fault)
            self.initial = initial
            fault = "b" if fault == "b" else "d"
        out["last_turn"], out["last_initial"] = turn, initial

    def row(self, is_open: bool) -> dict:
        weights = self.run.weights(whole=not is_open)
        paths = [{"entry": p, "exit": q, "cost": w[0], "audit": w[1]} for (p, q), w in sorted(weights.items())]
        return self.out | {"paths": paths, "open": is_open}


def legal(left: str, right: str) -> bool:
    return left + right in ("su", "ua", "au")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield from batch.slice(at, SLICE_ROWS).to_pylist()


def _in_slices(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows gathered to batches of bounded size."""
    kept: list[dict] = []
    size = 0
    for row in rows:
        kept.append(row)
        size += 100 + len(row.get("text") or "") + len(row.get("audit") or "")
        if len(kept) >= 2_000 or size > 8_000_000:
            yield pa.RecordBatch.from_pylist(kept, schema=schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema=schema)


def _fragments(codes: DataFrame) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(FRAGMENTS))

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now: _Fragment | None = None
        for row in _rows(batches):
            if now is None or row["conv_id"] != now.out["conv_id"]:
                if now is not None:
                    yield now.row(now.out["open"])
                # The task's first conversation may have begun in the task before.
                now = _Fragment(row, is_open=now is None)
            now.add(row)
        if now is not None:
            # The last one may go on in the next task.
            yield now.row(True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_slices(fragments(batches), arrow)

    ordered = codes.repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE)
    return map_batches(ordered, run, FRAGMENTS)


def _closed(fragments: DataFrame) -> DataFrame:
    goals = F.filter("paths", lambda p: (p["entry"] == 0) & p["exit"].isin(*GOALS))
    best = F.array_min(F.transform(goals, lambda p: F.struct(p["cost"], p["audit"])))
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0).cast("long"))
    counts = ["blank", "duplicate", "truncated", "illegal"]
    return fragments.withColumn("best", best).select(
        "conv_id", gaps.alias("gaps"), *counts, F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit")
    )


def _joined(fragments: DataFrame) -> DataFrame:
    """One fragment of each conversation that met a task's edge. There are at most as many as tasks, twice."""
    fields = StructType.fromDDL(FRAGMENTS)
    arrow = to_arrow_schema(fields)

    def of_conversation(table: pa.Table) -> pa.Table:
        def order(row: dict):
            return row["first_turn"] is not None, row["first_turn"] or 0, row["first_role"].encode(), row["first_digest"]

        parts = sorted(table.to_pylist(), key=order)
        out = parts[0]
        weights = None
        runs: list[tuple[int, Weights]] = []
        for k, part in enumerate(parts):
            weights = {(p["entry"], p["exit"]): (p["cost"], p["audit"]) for p in part["paths"]}
            size = 1
            while runs and runs[-1][0] == size:
                weights, size = joined(runs.pop()[1], weights), 2 * size
            runs.append((size, weights))
            if k:
                for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    out[name] += part[name]
                out["illegal"] += not legal(out["last_initial"], part["first_initial"])
                out["turns"] -= part["first_turn"] is not None and part["first_turn"] == out["last_turn"]
                if part["max_turn"] is not None:
                    out["max_turn"] = part["max_turn"]
                    out["min_turn"] = part["min_turn"] if out["min_turn"] is None else out["min_turn"]
                out["last_turn"], out["last_initial"] = part["last_turn"], part["last_initial"]
        weights = runs.pop()[1]
        while runs:
            weights = joined(runs.pop()[1], weights)
        out["paths"] = [{"entry": p, "exit": q, "cost": w[0], "audit": w[1]} for (p, q), w in weights.items() if p == 0]
        return pa.Table.from_pylist([out], schema=arrow)

    return fragments.groupBy("conv_id").applyInArrow(of_conversation, fields)


def repairs(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation that has turns."""
    fragments = stage(_fragments(_coded(_turns(conversations))), "fragments")
    return _closed(fragments.where("not open").unionByName(_joined(fragments.where("open"))))


def _apply(conversations: DataFrame, audits: DataFrame, schema: str, emit) -> DataFrame:
    """``emit(conv_id, turns)`` per conversation, ``turns`` being its repaired turns as they are read."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    turns = _turns(conversations).select("conv_id", F.lit(True).alias("is_turn"), "turn", "role", _digest(), "text")
    none = {"turn": "long", "role": "string", "digest": "binary"}
    heads = audits.select(
        "conv_id", F.lit(False).alias("is_turn"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.col("audit").alias("text")
    )

    def repaired(rows: Iterator[dict]) -> Iterator[dict]:
        head, waiting = None, next(rows, None)
        while waiting is not None:
            head, waiting = waiting, None

            def turns_of() -> Iterator[tuple[str, str, str]]:
                nonlocal waiting
                state = 0
                row = next(rows, None)
                for edit in head["text"]:
                    if edit != "I":
                        role, text = row["role"], row["text"]
                        row = next(rows, None)
                        if edit == "D":
                            yield edit, role, text
                            continue
                        if edit == "K":
                            state = NEXT[state][role[0]]
                            yield edit, role, text
                            continue
                    state = 3 if state == 2 else 2
                    yield edit, WRITTEN[state], "" if edit == "I" else text
                waiting = row

            yield from emit(head["conv_id"], turns_of())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_slices(repaired(_rows(batches)), arrow)

    stream = turns.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "is_turn", "turn", "role", "digest")
    return map_batches(stream, run, schema)


def repaired_turns(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations turn by turn, with the edit that made each (columns of ``TURNS``)."""

    def emit(conv_id, turns):
        place = 0
        for edit, role, text in turns:
            if edit != "D":
                yield {"conv_id": conv_id, "place": place, "edit": edit, "role": role, "text": text}
                place += 1

    return _apply(conversations, audits, TURNS, emit)


def repaired_digests(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation's lines ``role:text``."""

    def emit(conv_id, turns):
        digest, between = hashlib.sha256(), b""
        for edit, role, text in turns:
            if edit != "D":
                digest.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                between = b"\n"
        yield {"conv_id": conv_id, "repaired_sha256": digest.hexdigest()}

    return _apply(conversations, audits, DIGESTS, emit)


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """Each conversation of the table: its faults and repair after the turns are damaged, with a digest."""
    turns = damaged(conversations)
    found = stage(repairs(turns), "repairs")
    digests = repaired_digests(turns, found)
    names = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    key = F.struct("conv_id")
    out = names.select(key.alias("of")).join(found.select(key.alias("of"), "*").drop("conv_id"), "of", "left")
    out = out.join(digests.select(key.alias("of"), "repaired_sha256"), "of", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "of.conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
