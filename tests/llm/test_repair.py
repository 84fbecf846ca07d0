import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from weblake.llm import repair
from weblake.llm.repair import damaged, lightest, repaired_conversations, repaired_turns, repairs

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
FOLLOW = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(draw, text)
        for _ in range({0: 0, 3: 2}.get(draw, 1)):
            yield conv, turn, "user" if draw == 4 else role, text


def faults(turns):
    seen = set()
    for role, text in turns:
        shown = re.sub("[\x20\x09-\x0d]", "", text)
        yield "b" if not shown else "d" if (role, text) in seen else "k" if shown[-1] in ".!?" else "t"
        seen.add((role, text))


def cheapest(turns):
    """Least (cost, audit, lines) by trying every edit of every turn, row by row."""

    def keep(found, state, value):
        if state not in found or value[:2] < found[state][:2]:
            found[state] = value

    def inserted(found):
        for _ in range(3):
            for state, (cost, audit, lines) in list(found.items()):
                role = "assistant" if state == 2 else "user"
                keep(found, 3 if state == 2 else 2, (cost + 3, audit + "I", (*lines, role + ":")))
        return found

    found = {0: (0, "", ())}
    for (role, text), fault in zip(turns, faults(turns)):
        after = {}
        for state, (cost, audit, lines) in inserted(found).items():
            keep(after, state, (cost + 4, audit + "D", lines))
            if fault in "kt":
                more = 3 * (fault == "t")
                if (state, role[:1]) in FOLLOW:
                    keep(after, FOLLOW[state, role[:1]], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                new = "assistant" if state == 2 else "user"
                keep(after, 3 if state == 2 else 2, (cost + more + 3, audit + "R", (*lines, f"{new}:{text}")))
        found = after
    found = inserted(found)
    return min(found[s] for s in (0, 3) if s in found)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [r[1:] for r in damage(r for r in rows if r[0] == conv)]
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        pairs = [t[1:] for t in turns]
        kinds, numbers = list(faults(pairs)), [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, audit, lines = cheapest(pairs)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, digest)
    return out


def conversations(seed, turns):
    """Rows with nulls, ties, repeated rows, odd roles and blank texts; some conversations are long."""
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "unit", "Übung"]
    texts = [None, "", " \t", "Hi.", "Hi", "x y z?", "é! ", "z\n"]
    rows = []
    for conv, n in turns.items():
        for t in range(n):
            text = rng.choice([*texts, f"{t}.", f"{t}"])
            rows.append((conv, rng.choice([None, t, t, t, t // 2]), rng.choice(roles), text))
    return rows + rows[:7]


def table(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("digest", "copies", "fault", "audit", "place", "carried", "is_turn"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def by_conversation(frame):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in frame.collect()}


def test_matches_brute_force(spark):
    rows = conversations(1, {None: 9, 1: 130, 2: 0, 3: 1, 4: 8, **{i: i % 9 for i in range(5, 60)}})
    assert by_conversation(repaired_conversations(table(spark, rows))) == expected(rows)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_a_conversation_over_many_tasks(spark, monkeypatch, block):
    rows = conversations(block, {1: 20, 7: 900, 8: 300, 9: 4})
    monkeypatch.setattr(repair, "BLOCK", block)
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        turns = damaged(table(spark, rows))
        split = repair._fragments(repair._coded(repair._turns(turns))).groupBy("conv_id").count().agg(F.max("count")).first()[0]
        assert split > 3
        assert by_conversation(repaired_conversations(table(spark, rows))) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lightest_and_its_ties():
    assert lightest("", 0, (0, 3), True) == {0: (0, "")}
    # Two user turns: the second may be reroled.
    assert lightest("ukuk", 0, (0, 3), True) == {3: (3, "KR")}
    assert lightest("uk", 0, (0, 3), True) == {3: (3, "KI")}
    assert lightest("-k", 0, (0, 3), True) == {0: (4, "D")}
    # Truncated: staying costs 3 and still needs a reply, going costs 4.
    assert lightest("ut", 0, (0, 3), True) == {0: (4, "D")}
    # Insert and rerole in either order cost the same; ASCII decides.
    assert lightest("ukukuk", 0, (0, 3), True) == {3: (6, "KIKR")}


def test_repaired_turns_are_what_the_digest_says(spark):
    rows = conversations(3, {1: 12, 2: 5, 3: 40})
    turns = damaged(table(spark, rows))
    parts = {}
    for r in repaired_turns(turns, repairs(turns)).orderBy("conv_id", "place").collect():
        parts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert re.fullmatch("[KRI]", r["edit"])
    want = expected(rows)
    for conv, lines in parts.items():
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[conv][-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


def test_all_dropped_empty_and_long(spark):
    gone = next((c, t) for c in range(50) for t in range(50) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256().hexdigest()
    got = by_conversation(repaired_conversations(table(spark, [(*gone, "user", "x.")])))
    assert got == {gone[0]: (0, 0, 0, 0, 0, 0, "", empty)}
    assert repaired_conversations(table(spark, []).where("false")).count() == 0
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "word " * 200_000 + ".") for t in range(6)]
    assert by_conversation(repaired_conversations(table(spark, rows))) == expected(rows)


def test_equal_rows_travel_as_one(spark):
    rows = [(1, 1, "user", "same.")] * 3_000 + [(1, 2, "assistant", "same.")] * 5
    turns = damaged(table(spark, rows))
    assert repair._coded(repair._turns(turns)).count() <= 2
    assert by_conversation(repaired_conversations(table(spark, rows))) == expected(rows)
