"""Repair of conversation structure by Hirschberg's divide and conquer over four role states.

A conversation is right if its roles' initials read ``(s?(ua)+)?``. The cheapest edits that make it so are a
shortest path: rows are steps, and the states are what has been written so far (nothing, a system, a user or
an assistant row). A table of costs per row and state would grow with the conversation, so a conversation is
halved instead: a forward vector of four costs from its start and a backward vector from its end meet
in the middle, the best crossing is chosen, and both halves are solved the same way. The halves need no more than
the vectors at hand.

The halving goes on across tasks. Rows are sorted by range into blocks; a block is reduced to the costs between
its four entry and four exit states; only these meet per conversation, and each block is then solved between its two states.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import stage

# The damage by remainder, the costs of the edits, and the white space that makes a text blank.
REMAINDERS = 20
DROP, EMPTY, UNSTOP, REPEAT, ASUSER = 0, 1, 2, 3, 4
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
BLANK = " \t\n\x0b\x0c\r"

# States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
# The one role that may be inserted, or given to a row, in a state, and the state it leads to.
WRITES = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
# Inserts that close a conversation behind its last row.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

# A row is one character. Blank and duplicate rows are DEAD; others are their role's initial, or OTHER for
# initials that cannot be kept; truncated rows are upper-case.
DEAD, OTHER = "x", "o"


@lru_cache(maxsize=None)
def row_steps(kind: str) -> dict[tuple[int, int], tuple[int, str]]:
    """For each (entry, exit) state the cheapest edits around one row, inserts in front of it included, as cost
    and ASCII-least audit. At most nine kinds of rows exist."""
    steps: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(entry: int, state: int, cost: int, audit: str) -> None:
        best = steps.get((entry, state), (FAR, ""))
        if (cost, audit) < best:
            steps[entry, state] = (cost, audit)

    for entry in STATES:
        state, cost, audit = entry, 0, ""
        for _ in range(3):  # two inserts reach every state that inserts can reach
            offer(entry, state, cost + DELETE_COST, audit + "D")
            if kind != DEAD:
                late = TRUNCATED_COST if kind.isupper() else 0
                offer(entry, WRITES[state], cost + REROLE_COST + late, audit + "R")
                if kind.lower() in NEXT[state]:
                    offer(entry, NEXT[state][kind.lower()], cost + KEEP_COST + late, audit + "K")
            state, cost, audit = WRITES[state], cost + INSERT_COST, audit + "I"
    return steps


Vector = tuple[tuple[int, int], ...]  # per state the cost, and the place of its least audit among the states'


def forward(kinds: str, vector: Vector) -> Vector:
    """Costs of reaching each state behind the rows, with the order of their least audits.

    Audits of the same rows end with a row's edit, so none of them begins another one. Their
    order is therefore settled for good, and four ranks stand for four strings of any length.
    """
    for kind in kinds:
        best: dict[int, tuple] = {}
        for (entry, state), (cost, audit) in row_steps(kind).items():
            before, rank = vector[entry]
            if before < FAR:
                offered = (before + cost, rank, audit)
                if state not in best or offered < best[state]:
                    best[state] = offered
        order = sorted(best, key=lambda s: best[s][1:])
        vector = tuple((best[s][0], order.index(s)) if s in best else (FAR, len(STATES)) for s in STATES)
    return vector


def backward(kinds: str, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs of reaching the end from each state in front of the rows, given those behind them."""
    for kind in reversed(kinds):
        steps = row_steps(kind).items()
        best = [FAR] * len(STATES)
        for (entry, state), (cost, _) in steps:
            if costs[state] < FAR and cost + costs[state] < best[entry]:
                best[entry] = cost + costs[state]
        costs = tuple(best)
    return costs


def at_state(state: int) -> Vector:
    return tuple((0, 0) if s == state else (FAR, len(STATES)) for s in STATES)


def crossing(reached: Vector, rest: tuple[int, ...]) -> int:
    """The state in which the cheapest, and of these the audit-least, path crosses."""
    return min(STATES, key=lambda s: (reached[s][0] + rest[s], reached[s][1]))


@lru_cache(maxsize=1 << 16)
def _solved(kinds: str, entry: int, exit: int) -> str:
    if len(kinds) == 1:
        return row_steps(kinds)[entry, exit][1]
    middle = len(kinds) // 2
    left, right = kinds[:middle], kinds[middle:]
    rest = backward(right, tuple(0 if s == exit else FAR for s in STATES))
    state = crossing(forward(left, at_state(entry)), rest)
    return solved(left, entry, state) + solved(right, state, exit)


CACHED_ROWS = 64


def solved(kinds: str, entry: int, exit: int) -> str:
    """The cheapest, ASCII-least audit of rows between two states. Answers for short runs of rows are kept."""
    return _solved(kinds, entry, exit) if len(kinds) <= CACHED_ROWS else _solved.__wrapped__(kinds, entry, exit)


@lru_cache(maxsize=1 << 14)
def _reduced(kinds: str) -> list[int]:
    return [value for entry in STATES for pair in forward(kinds, at_state(entry)) for value in pair]


def reduced(kinds: str) -> list[int]:
    """A block as 4 x 4 pairs: the cost from each entry to each exit state and the rank of its least audit."""
    return _reduced(kinds) if len(kinds) <= CACHED_ROWS else _reduced.__wrapped__(kinds)


def chained(blocks: list[list[int]]) -> tuple[int, list[int]]:
    """Total cost, and the states at the blocks' borders, of a conversation given as reduced blocks.

    The costs from a border to the end come from behind; then each border is crossed where its block's
    forward vector and the backward vector behind it meet best.
    """
    ends = [tuple(INSERT_COST * len(CLOSING[s]) for s in STATES)]
    for block in reversed(blocks):
        behind = ends[-1]
        ends.append(
            tuple(min(min(FAR, block[8 * s + 2 * t] + behind[t]) for t in STATES) for s in STATES)
        )
    ends.reverse()
    borders = [START]
    for block, rest in zip(blocks, ends[1:]):
        row = block[8 * borders[-1] : 8 * borders[-1] + 8]
        borders.append(crossing(tuple(zip(row[::2], row[1::2])), rest))
    return ends[0][START], borders


def edits_of(audit: str, kinds: str, entry: int) -> list[str]:
    """Per row its edits: the inserts in front of it and its own, as the roles to write (``u``, ``a``, or ``k`` to
    keep the row's own role); a deleted row writes nothing of its own."""
    rows, state, written, at = [], entry, "", 0
    for edit in audit:
        if edit == "I":
            state = WRITES[state]
            written += "U" if state == USER else "A"
            continue
        if edit == "K":
            state = NEXT[state][kinds[at].lower()]
            written += "k"
        elif edit == "R":
            state = WRITES[state]
            written += "u" if state == USER else "a"
        rows.append(written)
        written, at = "", at + 1
    return rows


def damaged(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that each row's ``conv_id:turn`` decides.

    A NULL is one space, in the text and the role as well as in the digest's ``conv_id:turn``.
    """
    space = F.lit(" ")
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    fate = F.crc32(name.cast("binary")) % REMAINDERS
    text = F.coalesce(F.col("text"), space)
    text = F.when(fate == EMPTY, "").when(fate == UNSTOP, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fate == ASUSER, "user").otherwise(F.coalesce(F.col("role"), space))
    rows = df.filter(fate != DROP).select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fate == REPEAT, 2).otherwise(1).alias("copies")
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


# Rows of a conversation: by turn, NULL first; rows of one turn by role and the digest of their text.
ORDER = ("conv_id", "turn", "role", "digest")


def _digest(text: str = "text") -> Column:
    return F.unhex(F.sha1(F.col(text).cast("binary")))


def ordered_marks(rows: DataFrame) -> DataFrame:
    """The rows without their texts, sorted by range: ``ORDER``, ``part``, ``seq`` (the order over all rows), and
    whether the text is ``blank`` or ``truncated``. Equal rows, and conversations of any length, spread over parts.
    """
    last = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    marks = rows.select(
        "conv_id", "turn", "role", _digest().alias("digest"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
        F.monotonically_increasing_id().alias("salt"),
    )
    keys = [*ORDER, "salt"]
    laid = marks.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
    laid = laid.sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys]).drop("salt")
    return stage(
        laid.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "dialog-rows"
    )


def blocks_of(marks: DataFrame) -> DataFrame:
    """One row per conversation and part: its rows' ``kinds`` and ``initials`` in order, its counts, and the
    keys by which its texts are found again. A row is a duplicate unless it is the first of its role and text."""
    firsts = marks.groupBy("conv_id", "role", "digest").agg(F.min("seq").alias("seq"))
    # Joined by the row number, which no two rows share: a text that fills a conversation is not a hot key here.
    flagged = marks.join(firsts.select("seq", F.lit(True).alias("first")), "seq", "left")
    initial = F.left("role", F.lit(1))
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit(OTHER))
    kind = (
        F.when(F.col("blank") | F.col("first").isNull(), F.lit(DEAD))
        .when(F.col("truncated"), F.upper(plain))
        .otherwise(plain)
    )
    counted = {
        "blank": F.col("blank"),
        "duplicate": ~F.col("blank") & F.col("first").isNull(),
        "truncated": ~F.col("blank") & F.col("first").isNotNull() & F.col("truncated"),
    }
    row = F.struct("seq", kind.alias("kind"), plain.alias("initial"), "turn", "role", "digest")
    grouped = flagged.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(row)).alias("rows"),
        *[F.count_if(flag).alias(name) for name, flag in counted.items()],
    )
    return grouped.select(
        "*",
        F.array_join(F.transform("rows", lambda r: r["kind"]), "").alias("kinds"),
        F.array_join(F.transform("rows", lambda r: r["initial"]), "").alias("initials"),
    )


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


@F.pandas_udf(_struct(illegal=T.LongType(), reduced=T.ArrayType(T.LongType())))
def _reduce(kinds: pd.Series, initials: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"illegal": initials.map(_illegal), "reduced": kinds.map(reduced)})


@F.pandas_udf(_struct(cost=T.LongType(), borders=T.ArrayType(T.IntegerType()), illegal=T.LongType()))
def _chain(blocks: pd.Series) -> pd.DataFrame:
    rows = []
    for conversation in blocks:
        parts = list(conversation)
        cost, borders = chained([list(p["reduced"]) for p in parts])
        ends = [_illegal(a["last"] + b["first"]) for a, b in zip(parts, parts[1:])]
        rows.append((cost, borders, sum(ends) + sum(p["illegal"] for p in parts)))
    return pd.DataFrame(rows, columns=["cost", "borders", "illegal"])


@F.pandas_udf(_struct(audit=T.StringType(), edits=T.ArrayType(T.StringType())))
def _solve(kinds: pd.Series, entry: pd.Series, exit: pd.Series) -> pd.DataFrame:
    rows = []
    for kind, a, b in zip(kinds, entry, exit):
        audit = solved(kind, a, b)
        rows.append((audit, edits_of(audit, kind, a)))
    return pd.DataFrame(rows, columns=["audit", "edits"])


def written_lines(edits: str, role: str, text: str) -> list[str]:
    """The lines ``role:text`` that a row's edits write, inserted ones first."""
    names = {"U": "user:", "A": "assistant:", "u": "user:" + text, "a": "assistant:" + text, "k": f"{role}:{text}"}
    return [names[e] for e in edits]


def repaired_digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv_id`` and the SHA-256 of the repaired conversation.

    ``edits`` holds a row's keys (``ORDER``), ``seq``, ``edits`` and ``closing`` (the inserts behind its conversation's
    last row). A digest is sequential by definition, so the texts of a conversation stream through one
    task in order; the task holds one batch and the state of one digest, whatever the length.
    """
    texts = rows.select("conv_id", "turn", "role", _digest().alias("digest"), "text")
    both = edits.unionByName(texts, allowMissingColumns=True)
    both = both.withColumn("is_text", F.col("seq").isNull())
    keys = [F.col(k).asc_nulls_first() for k in (*ORDER, "is_text", "seq")]
    laid = both.repartition("conv_id").sortWithinPartitions(*keys)
    laid = laid.select("conv_id", "is_text", "role", "text", "edits", "closing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(ids, digests):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests)], names=["conv_id", "repaired"])

        current, digest, empty, waiting = None, None, True, deque()
        for batch in batches:
            ids, digests = [], []
            for conv, is_text, role, text, edit, closing in zip(*[c.to_pylist() for c in batch.columns]):
                if digest is None or conv != current:
                    if digest is not None:
                        ids.append(current)
                        digests.append(digest.hexdigest())
                    current, digest, empty = conv, hashlib.sha256(), True
                if not is_text:
                    waiting.append((edit, closing))
                    continue
                edit, closing = waiting.popleft()
                for line in written_lines(edit + closing, role, text):
                    digest.update((line if empty else "\n" + line).encode())
                    empty = False
            if ids:
                yield result(ids, digests)
        if digest is not None:
            yield result([current], [digest.hexdigest()])

    return laid.mapInArrow(run, "conv_id long, repaired string")


def repaired_conversations(df: DataFrame) -> DataFrame:
    """Damage every row of a table of conversations, then repair them: one row per original ``conv_id``.

    ``gaps, blank, duplicate, truncated, illegal`` describe the conversation after the damage; ``cost`` and ``audit`` are
    the cheapest edits and ``repaired_sha256`` the digest of the result. NULL ids form one conversation.
    NULL texts and roles are one space: blank, and no role to keep. Repeated rows are duplicates. A conversation whose rows
    are all dropped has zeros, an empty audit and the empty string's digest. An empty table gives none. Columns
    other than ``conv_id, turn, role, text`` are not read.
    """
    whole = df.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    rows = damaged(whole)
    marks = ordered_marks(rows)
    blocks = blocks_of(marks)
    blocks = stage(blocks.withColumn("r", _reduce("kinds", "initials")).select("*", "r.*").drop("r"), "dialog-blocks")

    part = F.struct(
        "part", F.left("initials", F.lit(1)).alias("first"), F.right("initials", F.lit(1)).alias("last"), "illegal", "reduced"
    )
    joined = blocks.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(part)).alias("parts"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    solved_parts = stage(joined.withColumn("c", _chain("parts")).select("*", "c.*").drop("c"), "dialog-paths")

    placed = solved_parts.select(
        F.col("conv_id").alias("conv"), F.posexplode("parts.part").alias("i", "p"), "borders"
    ).select(
        "conv", "p", F.col("borders")[F.col("i")].alias("entry"), F.col("borders")[F.col("i") + 1].alias("exit"),
        (F.col("i") == F.size("borders") - 2).alias("ends"),
    )
    paths = blocks.join(placed, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("p")))
    closing = F.when(
        F.col("ends"),
        F.when(F.col("exit") == SYSTEM, "UA").when(F.col("exit") == USER, "A").otherwise(""),
    ).otherwise("")
    inserts = F.repeat(F.lit("I"), F.length("closing"))
    paths = stage(
        paths.withColumn("s", _solve("kinds", "entry", "exit")).select(
            "conv_id", "part", "rows", F.col("s.audit").alias("audit"), F.col("s.edits").alias("edits"), closing.alias("closing")
        ),
        "dialog-audits",
    )
    steps = paths.select(
        "conv_id", "closing", F.size("rows").alias("n"), F.posexplode(F.arrays_zip("rows", "edits")).alias("i", "row")
    )
    edits = steps.select(
        "conv_id", "row.rows.turn", "row.rows.role", "row.rows.digest", "row.rows.seq", "row.edits",
        F.when(F.col("i") == F.col("n") - 1, F.col("closing")).otherwise("").alias("closing"),
    )
    audits = paths.groupBy("conv_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("part", F.concat("audit", inserts).alias("audit")))), lambda p: p["audit"]
            ),
            "",
        ).alias("audit")
    )
    turns = marks.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")
    )
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    pieces = [
        turns,
        solved_parts.select("conv_id", *counts),
        audits,
        repaired_digests(rows, edits),
    ]
    whole_rows = whole.select("conv_id").distinct()
    for piece in pieces:  # one row per conversation each
        whole_rows = whole_rows.unionByName(piece, allowMissingColumns=True)
    gathered = whole_rows.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *counts)],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
    return gathered


def _offer(state: int, cost: int, audit: str, line: str = "''") -> str:
    """SQL: the path to a state, longer by one edit and by what it writes."""
    return f"{{'c': v[{state + 1}].c + {cost}, 'a': v[{state + 1}].a || '{audit}', 't': v[{state + 1}].t || {line}}}"


def _insert(state: int) -> str:
    return _offer(state, INSERT_COST, "I", f"'{ROLES[WRITES[state]]}:' || chr(10)")


def _edit(kind: str, state: int, role: str) -> list[str]:
    """SQL: the ways over a row to a state from those that precede it; out of reach where the row does not allow them."""
    before = [s for s in STATES if WRITES[s] == state]
    far = f"{{'c': {1 << 40}, 'a': '', 't': ''}}"
    late = f"(case when late then {TRUNCATED_COST} else 0 end)"
    reroled = [_offer(s, f"{REROLE_COST} + {late}", "R", f"'{role}:' || text || chr(10)") for s in before]
    kept = [(_offer(s, late, "K", "role || ':' || text || chr(10)"), f"initial = '{kind}'") for s in before]
    return [f"case when not dead then {o} else {far} end" for o in reroled] + [
        f"case when not dead and {test} then {o} else {far} end" for o, test in kept
    ]


def _least(paths: list[str]) -> str:
    return "list_min([" + ", ".join(paths) + "])"


_UNREACHED = f"{{'c': {1 << 40}, 'a': '', 't': ''}}"
_ONCE = [f"v[{s + 1}]" if s in (START, SYSTEM) else _least([f"v[{s + 1}]", *[_insert(b) for b in STATES if WRITES[b] == s]]) for s in STATES]
_OVER = [
    [_offer(START, DELETE_COST, "D")],
    [_offer(SYSTEM, DELETE_COST, "D"), f"case when not dead and initial = 's' then {_offer(START, '(case when late then 1 else 0 end)', 'K', 'role || chr(58) || text || chr(10)')} else {_UNREACHED} end"],
    [_offer(USER, DELETE_COST, "D"), *_edit("u", USER, "user")],
    [_offer(ASSISTANT, DELETE_COST, "D"), *_edit("a", ASSISTANT, "assistant")],
]

# The same rows by a plain forward table of the four states' cheapest paths, with a bitwise CRC-32 of the name.
ORACLE_SQL = f"""
with recursive named as (
  select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
fated as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(name, ''), lambda c: ascii(c)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
      lambda x, i: xor(x >> 1, (x & 1) * 3988292384::bigint))), 4294967295::bigint) % {REMAINDERS} as fate from named),
spread as (
  select conv_id, turn, case when fate = {ASUSER} then 'user' else role end as role,
    case fate when {EMPTY} then '' when {UNSTOP} then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when fate = {REPEAT} then 2 else 1 end)) as copy
  from fated where fate <> {DROP}),
ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha1(text)) as i,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last, left(role, 1) as initial
  from spread),
seen as (
  select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    lag(initial) over (partition by conv_id order by i) as before from ordered),
judged as (
  select *, last = '' as blank, last <> '' and again as duplicate, last <> '' and not again and last not in ('.', '!', '?') as late,
    last = '' or again as dead from seen),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank,
    count(*) filter (where duplicate) as duplicate, count(*) filter (where late) as truncated,
    count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from judged group by conv_id),
path as (
  select conv_id, n, 0::bigint as i, [{{'c': 0::bigint, 'a': '', 't': ''}}, {", ".join([_UNREACHED] * 3)}] as v from counts
  union all
  select conv_id, n, i, [{", ".join(_least(o) for o in _OVER)}] as v from (
    select p.conv_id, p.n, j.i, j.role, j.text, j.late, j.dead, j.initial, [{", ".join(_ONCE)}] as v from (
      select conv_id, n, i, [{", ".join(_ONCE)}] as v from path) p
    join judged j on j.conv_id is not distinct from p.conv_id and j.i = p.i + 1)),
closed as (
  select conv_id, [{", ".join(_ONCE)}] as v from (select conv_id, [{", ".join(_ONCE)}] as v from path where i = n)),
ended as (select conv_id, list_min([v[{START + 1}], v[{ASSISTANT + 1}]]) as best from closed)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost,
  coalesce(best.a, '') as audit, sha256(coalesce(left(best.t, -1), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id left join ended e on e.conv_id is not distinct from o.conv_id
"""
