"""Conversation repair against a plain search over all states, and against SQL on the test tables."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from segmentry.llm import dialogs

SCHEMA = "conv_id long, turn long, role string, text string, seq long, part string, rows long, audit string"


def cheapest(kinds: str) -> tuple[int, str]:
    """Cost and least audit by trying every edit at every row and state."""

    @lru_cache(maxsize=None)
    def best(at: int, state: int, inserts: int) -> tuple[int, str]:
        ways = []
        if at == len(kinds):
            if state in (dialogs.START, dialogs.ASSISTANT):
                ways.append((0, ""))
        else:
            kind = kinds[at]
            late = int(kind.isupper())
            steps = [(3, "D", state)]
            if kind != "x":
                steps.append((2 + late, "R", dialogs.WRITES[state]))
                if kind.lower() in dialogs.NEXT[state]:
                    steps.append((late, "K", dialogs.NEXT[state][kind.lower()]))
            for cost, edit, after in steps:
                rest = best(at + 1, after, 0)
                ways.append((cost + rest[0], edit + rest[1]))
        if inserts < 3:
            rest = best(at, dialogs.WRITES[state], inserts + 1)
            ways.append((2 + rest[0], "I" + rest[1]))
        return min(ways, default=(1 << 40, ""))

    return best(0, dialogs.START, 0)


def expected(rows) -> dict:
    """The whole contract, row by row, for rows (conv_id, turn, role, text)."""
    conversations: dict = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        conversations[conv] += [(turn, role, text)] * (2 if fate == 3 else 1)
    found = {}
    for conv, members in conversations.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha1(r[2].encode()).digest()))
        turns = [t for t, _, _ in members if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, kinds, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in members:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            kind = role[:1] if role[:1] and role[:1] in "sua" else "o"
            if not last:
                faults["blank"] += 1
                kind = "x"
            elif (role, text) in seen:
                faults["duplicate"] += 1
                kind = "x"
            elif last not in ".!?":
                faults["truncated"] += 1
                kind = kind.upper()
            seen.add((role, text))
            kinds += kind
        initials = [r[:1] for _, r, _ in members]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(kinds)
        lines, state, at = [], dialogs.START, 0
        for edit in audit:
            if edit in "IR":
                state = dialogs.WRITES[state]
            elif edit == "K":
                state = dialogs.NEXT[state][members[at][1][0]]
            if edit == "I":
                lines.append(dialogs.ROLES[state] + ":")
                continue
            if edit in "KR":
                lines.append((members[at][1] if edit == "K" else dialogs.ROLES[state]) + ":" + members[at][2])
            at += 1
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        found[conv] = (gaps, *faults.values(), illegal, cost, audit, digest)
    return found


def answers(df) -> dict:
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = dialogs.repaired_conversations(df).collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


@pytest.mark.parametrize("length", [1, 2, 3, 5, 9, 40, 150])
def test_halving_equals_the_plain_search(length):
    state = random.Random(length)
    for _ in range(60):
        kinds = "".join(state.choice("suaosUAOx" + "uaua") for _ in range(length))
        cost, audit = cheapest(kinds)
        cuts = sorted(state.sample(range(length + 1), min(length, state.randint(0, 4))))
        parts = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, length]) if a < b]
        found, borders = dialogs.chained([dialogs.reduced(p) for p in parts])
        pieces = [dialogs.solved(p, a, b) for p, a, b in zip(parts, borders, borders[1:])]
        assert (found, "".join(pieces) + dialogs.CLOSING[borders[-1]]) == (cost, audit)


def test_memory_of_the_halving_stays_flat():
    kinds = "".join(random.Random(5).choice("uaUAx") for _ in range(3000))
    assert dialogs.solved(kinds, dialogs.START, dialogs.ASSISTANT).count("D") >= kinds.count("x")


def odd_rows(seed=3):
    state = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", None, "word " * 2000 + ".", "Ends. ", "a\nb!", "é…"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    rows = []
    for conv in [*range(40), None, -3]:
        n = state.randint(1, 12)
        turns = [state.choice([None, i, i, i, i + 3]) for i in range(n)]
        rows += [(conv, t, state.choice(roles), state.choice(texts)) for t in turns]
    return rows + rows[:5] + [(77, 5, "user", "Same.")] * 30


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "p", 9, "z") for r in rows], SCHEMA)


def test_odd_rows(spark):
    rows = odd_rows()
    assert answers(frame(spark, rows)) == expected(rows)


def test_one_conversation_over_many_parts(spark):
    """A conversation with most of all rows is cut into blocks, whose borders are crossed as in one piece."""
    state = random.Random(11)
    rows = [(1, i, state.choice(["user", "assistant", "user", "tool"]), f"{i % 37} {state.choice('.a')}") for i in range(700)]
    rows += [(c, 0, "user", "Hi.") for c in range(2, 60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, rows).repartition(5)
        assert dialogs.ordered_marks(dialogs.damaged(df)).filter("conv_id = 1").select("part").distinct().count() > 2
        assert answers(df) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_conversations(spark):
    assert answers(frame(spark, [])) == {}


def test_a_conversation_that_is_dropped_whole(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi.")]
    assert answers(frame(spark, rows)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_layout_does_not_matter(spark):
    df = frame(spark, odd_rows(8))
    assert answers(df.repartition(7)) == answers(df.coalesce(1).orderBy(F.desc("text")))
