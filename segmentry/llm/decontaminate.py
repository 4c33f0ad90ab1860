"""Benchmark passages in documents: pigeonhole pieces, exact hits, Myers bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import as_column
from ..sources.staging import stage_next

BETWEEN = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class LeakRules:
    """Production parameters: edits allowed per character of the normal item, and text held by one block of items."""

    error_rate: float = 0.08
    block_chars: int = 4_000_000


def normal_text(text: str | None) -> str:
    """Lower-cased letters and digits, one blank for whatever lies between them."""
    return BETWEEN.sub(" ", (text or "").lower()).strip()


def pieces(pattern: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces with their offsets: of ``budget`` edits, none touches at least one of them."""
    edges = [len(pattern) * i // (budget + 1) for i in range(budget + 2)]
    return [(start, pattern[start:end]) for start, end in zip(edges, edges[1:])]


class Myers:
    """Edit distance of a pattern to the best substring, all rows of a column in one integer."""

    def __init__(self, pattern: str):
        self.length = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Smallest distance to a substring of ``text`` and the first place where such a substring ends."""
        full, top, get = (1 << self.length) - 1, 1 << (self.length - 1), self.masks.get
        up, down, score = full, 0, self.length
        found = (score, 0)
        for end, c in enumerate(text, 1):
            equal = get(c, 0)
            vertical = equal | down
            horizontal = (((equal & up) + up) ^ up) | equal
            rises, falls = (down | ~(horizontal | up)) & full, up & horizontal
            if rises & top:
                score += 1
            elif falls & top:
                score -= 1
                if score < found[0]:
                    found = (score, end)
            rises, falls = rises << 1 & full, falls << 1 & full
            up, down = falls | (~(vertical | rises) & full), rises & vertical
        return found


class Matcher:
    """All items of one block: an automaton over their pieces, and their patterns.

    Patterns and texts get a blank at both ends, so an item begins and ends at a word's border.
    """

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(item, f" {p} ", int(len(p) * error_rate)) for item, p in items]
        self.owners: dict[str, list[tuple[int, int]]] = {}
        for nth, (_, pattern, budget) in enumerate(self.items):
            for offset, piece in pieces(pattern, budget):
                self.owners.setdefault(piece, []).append((nth, offset))
        self.automaton = ahocorasick.Automaton()
        for piece in self.owners:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.patterns: dict[int, tuple[Myers, Myers]] = {}

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Per item the stretches of the text that can hold a match; overlapping ones are joined."""
        starts: dict[int, set[int]] = {}
        for end, piece in self.automaton.iter(text):
            for nth, offset in self.owners[piece]:
                starts.setdefault(nth, set()).add(end + 1 - len(piece) - offset)
        found = {}
        for nth, at in starts.items():
            _, pattern, budget = self.items[nth]
            joined: list[list[int]] = []
            for start in sorted(at):
                first, last = max(0, start - budget), min(len(text), start + len(pattern) + budget)
                if joined and first <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], last)
                else:
                    joined.append([first, last])
            found[nth] = [tuple(x) for x in joined]
        return found

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """``item``, ``distance``, ``start`` and ``end`` of the best match of each item that stays in its budget.

        The span leaves out blanks at its ends.
        """
        if not text:
            return
        text = f" {text} "
        for nth, stretches in self.windows(text).items():
            item, pattern, budget = self.items[nth]
            if nth not in self.patterns:
                self.patterns[nth] = Myers(pattern), Myers(pattern[::-1])
            forward, backward = self.patterns[nth]
            best = None
            for first, last in stretches:
                at = text.find(pattern, first, last)
                distance, end = (0, at + len(pattern) - first) if at >= 0 else forward.best(text[first:last])
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, first, first + end)
            if best:
                distance, first, end = best
                start = end - backward.best(text[first:end][::-1])[1]
                yield item, distance, start - (text[start] != " "), end - 1 - (text[end - 1] == " ")


MATCH = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("distance", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)
ARROW_MATCH = pa.list_(
    pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
)


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The test items with text, in blocks of at most ``block_chars`` characters (or one item)."""
    block, size = [], 0
    for row in items.toLocalIterator():
        pattern = normal_text(row["text"])
        if not pattern:
            continue
        if block and size + len(pattern) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], pattern))
        size += len(pattern)
    if block:
        yield block


def leaks(
    df: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    rules: LeakRules | None = None,
) -> DataFrame:
    """Best match of every test item in every document that holds it: ``doc_id``, ``item_id``, ``distance``, span.

    Both sides are compared as lower-cased letters and digits with one blank between words; ``start`` and
    ``end`` count characters of that form. Both get a blank at each end, and a document holds an item if some
    substring is within 8 % of the item's characters in edits; so an item inside a longer word costs edits, and
    one too short for any edit is found as whole words only. An item is cut into that budget plus one pieces, one of
    which must occur unchanged; hits are verified around their place. NULL, empty and wordless texts and
    items match nothing; equal items each match; NULL ids are carried; repeated documents each give their rows.
    The items, a stated query set, go to the tasks in blocks of bounded size, one pass over the documents each.
    """
    rules = rules or LeakRules()
    spark = df.sparkSession
    source = df.select(as_column(key).alias("doc_id"), as_column(text).alias("text"))
    queries = items.select(as_column(item_key).cast("long").alias("item_id"), as_column(item_text).alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("found", MATCH)])
    rate = rules.error_rate

    def search(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                found = []
                for value in batch.column(1):
                    matches = matcher.search(normal_text(value.as_py()))
                    found.append([dict(zip(("item_id", "distance", "start", "end"), m)) for m in matches])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(found, ARROW_MATCH)], names=schema.fieldNames()
                )

        return source.mapInArrow(run, schema).select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")

    parts = [search(block) for block in item_blocks(queries, rules.block_chars)]
    if not parts:
        return spark.createDataFrame([], T.StructType([source.schema["doc_id"], *MATCH.elementType.fields]))
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


def remove_leaking(docs: DataFrame, items: DataFrame, rules: LeakRules | None = None) -> DataFrame:
    """``docs`` without the documents that hold a test item, as ``leaks`` finds them.

    Each row is kept or dropped where its text is searched; only texts go to Python and nothing is joined. With several blocks of
    items, what one block leaves is stored for the next, and only the last of these tables stays.
    """
    rules = rules or LeakRules()
    spark = docs.sparkSession
    queries = items.select(F.col("item_id").cast("long").alias("item_id"), "text")

    def search(left: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            matcher = Matcher(shared.value, rules.error_rate)
            for texts in batches:
                found = [any(True for _ in matcher.search(normal_text(t.as_py()))) for t in texts]
                yield pa.array(found, pa.bool_())

        return left.filter(~F.arrow_udf(holds, "boolean")("text"))

    left, path = docs, None
    for block in item_blocks(queries, rules.block_chars):
        if left is not docs:
            left, path = stage_next(left, "leak-rest", path)
        left = search(left, block)
    return left
