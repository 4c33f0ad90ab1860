"""Ranked lexical search with hashed max-sketches.

The index keeps, per document, a sketch: its terms are hashed into slots, and a slot keeps the largest of the
impacts that fall into it. A document's impact of a term grows with the term's frequency and with nothing else that differs
inside the document, so the largest frequency stands for the largest impact. A query looks its terms' slots up
and adds their impacts times the terms' weights: no document scores more than that bound. Documents are
rescored exactly in falling order of their bounds, until the bound is below the last score that still counts.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import as_column
from ..sources.staging import stage
from .batches import batches_of, slices

# Terms, weights and scores.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SCALE = 1_000_000_000
TOP = 20

SLOTS_PER_TERM = 16  # a sketch has the next power of two of slots; most are zero, which storage packs
FULL = 255  # a slot keeps frequencies below; this value means any frequency, and the largest impact
LIMIT = SCALE // 1000  # no impact reaches it
BATCH_BYTES = 4 << 20
BATCH_ROWS = 500  # rows handed to a task at once; sketches are several times as large as their texts
PARTIAL_TERMS = 200_000  # distinct terms whose document counts a task gathers before it passes them on
BLOCK_TERMS = 20_000  # terms, with repeats, of the items answered in one scan
LOOKUPS = 1_000_000  # slots looked up at once

INDEX = "doc_id {id}, n long, sketch binary, terms binary, tfs binary, term string, df long"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.translate(LOWER)) if text else []


def term_hashes(terms: list[str]) -> np.ndarray:
    """A 32-bit hash per term, the same in every process: a polynomial over its UTF-8 bytes, then mixed."""
    if not terms:
        return np.empty(0, np.uint32)
    encoded = [t.encode() for t in terms]
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    flat = np.frombuffer(b"".join(encoded), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(sizes)
    place = np.arange(len(flat), dtype=np.int64) - np.repeat(ends - sizes, sizes)
    powers = np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64)
    powers = np.cumprod(powers, dtype=np.uint64)
    mixed = np.add.reduceat(flat * powers[place], ends - sizes)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)).astype(np.uint32)


def sketch_of(hashes: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    """The largest frequency per slot, one byte each; the number of slots grows with that of the terms."""
    slots = 1 << max(3, int(SLOTS_PER_TERM * len(hashes) - 1).bit_length())
    sketch = np.zeros(slots, np.uint8)
    np.maximum.at(sketch, hashes & np.uint32(slots - 1), np.minimum(frequencies, FULL).astype(np.uint8))
    return sketch


def search_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: a row per document that has terms, and rows ``term``, ``df`` with partial document counts.

    A document's row holds its number of terms ``n``, its ``sketch``, and its distinct ``terms`` (zero bytes between
    them) with their frequencies ``tfs`` for the exact score. Every text is read whole, in one pass.
    """
    source = docs.select(as_column(key).alias("doc_id"), as_column(text).alias("__text"))
    ids = source.schema["doc_id"].dataType
    schema = INDEX.format(id=ids.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter = Counter()
        id_type = None

        def document_counts():
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(known), id_type), pa.nulls(len(known), pa.int64())]
                + [pa.nulls(len(known), pa.binary())] * 3
                + [pa.array(known.keys(), pa.string()), pa.array(known.values(), pa.int64())],
                names=["doc_id", "n", "sketch", "terms", "tfs", "term", "df"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in slices(batch, 1, BATCH_BYTES):
                kept, sizes, sketches, lists, tfs = [], [], [], [], []
                for place, value in enumerate(part.column(1)):
                    counts = Counter(terms_of(value.as_py()))
                    if not counts:
                        continue
                    distinct = list(counts)
                    frequencies = np.fromiter(counts.values(), np.uint32, len(distinct))
                    kept.append(place)
                    sizes.append(int(frequencies.sum()))
                    sketches.append(sketch_of(term_hashes(distinct), frequencies).tobytes())
                    lists.append("\0".join(distinct).encode())
                    tfs.append(frequencies.tobytes())
                    known.update(distinct)
                    if len(known) >= PARTIAL_TERMS:
                        yield document_counts()
                        known.clear()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64())]
                    + [pa.array(v, pa.binary()) for v in (sketches, lists, tfs)]
                    + [pa.nulls(len(kept), pa.string()), pa.nulls(len(kept), pa.int64())],
                    names=["doc_id", "n", "sketch", "terms", "tfs", "term", "df"],
                )
        if known:
            yield document_counts()

    with batches_of(docs.sparkSession, BATCH_ROWS):
        return stage(source.mapInArrow(run, schema), "search-index")


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item_id, item, term, tf`` per distinct term of each item; ``item`` numbers the distinct (id, text) pairs."""
    lowered = F.translate(as_column(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = items.select(as_column(key).alias("item_id"), F.regexp_extract_all(lowered, F.lit(TERM.pattern), F.lit(0)).alias("terms"))
    listed = stage(listed.filter(F.size("terms") > 0).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    counted = listed.select("item_id", "item", F.explode("terms").alias("term")).groupBy("item_id", "item", "term")
    return counted.agg(F.count(F.lit(1)).alias("tf"))


def weighted_items(items: DataFrame, index: DataFrame, documents: int) -> DataFrame:
    """Adds each term's weight, from its document count; terms that no document has are left out."""
    wanted = items.select("term").distinct()
    counts = index.filter(F.col("term").isNotNull()).join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = F.lit(2.0 * documents + 2.0) / (2.0 * F.col("df") + 1.0)
    return items.join(counts, "term").withColumn("weight", F.floor(1000.0 * F.log(ratio)).cast("long"))


def impacts(frequencies: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What a term adds per unit of weight, given its frequency and the document's length measure ``m``."""
    return SCALE * frequencies // (1000 * frequencies + 12 * lengths)


class Block:
    """A bounded set of items: its terms' hashes, and per item its terms and their weights times their repeats."""

    def __init__(self, rows):
        self.items = sorted({r["item"] for r in rows})
        place = {item: i for i, item in enumerate(self.items)}
        self.terms = sorted({r["term"] for r in rows})
        at = {term: i for i, term in enumerate(self.terms)}
        rows = sorted(rows, key=lambda r: (place[r["item"]], at[r["term"]]))
        self.hashes = term_hashes(self.terms)
        self.columns = np.array([at[r["term"]] for r in rows], np.int64)
        self.weights = np.array([r["weight"] * r["tf"] for r in rows], np.int64)
        owners = np.array([place[r["item"]] for r in rows], np.int64)
        self.starts = np.searchsorted(owners, np.arange(len(self.items)))
        self.by_term = at

    def bounds(self, sketches: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Per document and item what the score cannot exceed."""
        sizes = np.fromiter(map(len, sketches), np.int64, len(sketches))
        flat = np.frombuffer(b"".join(sketches), np.uint8)
        starts = np.cumsum(sizes) - sizes
        slots = self.hashes[None, :].astype(np.int64) & (sizes - 1)[:, None]
        most = flat[starts[:, None] + slots].astype(np.int64)
        found = np.where(most == FULL, LIMIT, impacts(most, lengths[:, None]))
        return np.add.reduceat(found[:, self.columns] * self.weights, self.starts, axis=1)

    def scores(self, terms: bytes, tfs: bytes, length: int, wanted: np.ndarray) -> list[int]:
        """A document's exact scores for the wanted items."""
        frequencies = np.frombuffer(tfs, np.uint32).astype(np.int64)
        found = np.zeros(len(self.terms), np.int64)
        for term, tf in zip(terms.decode().split("\0"), impacts(frequencies, np.int64(length)).tolist()):
            place = self.by_term.get(term)
            if place is not None:
                found[place] = tf
        ends = np.append(self.starts[1:], len(self.columns))
        return [
            int(found[self.columns[self.starts[i] : ends[i]]] @ self.weights[self.starts[i] : ends[i]]) for i in wanted
        ]


class Best:
    """The best ``top`` documents of one item so far: highest score, then smallest id (NULL last)."""

    def __init__(self, top: int):
        self.top, self.heap, self.threshold = top, [], 1

    def add(self, score: int, doc) -> None:
        entry = (score, doc is not None, -doc if doc is not None else 0)
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)
        if len(self.heap) == self.top:
            self.threshold = max(1, self.heap[0][0])

    def rows(self):
        return [(score, -negative if present else None) for score, present, negative in self.heap]


def search_part(batches: Iterator[pa.RecordBatch], block: Block, total: int, documents: int, top: int):
    """The best documents of one part of the index for each item: ``(item, doc_id, score)``."""
    best = [Best(top) for _ in block.items]
    step = max(1, LOOKUPS // max(1, len(block.terms), len(block.columns)))
    for batch in batches:
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step).to_pydict()
            sizes = np.array(part["n"], np.int64)
            lengths = 75 + 25 * sizes * documents // total
            bounds = block.bounds(part["sketch"], lengths)
            # Falling bounds per item; the documents of one rank are rescored for all items that still want them.
            order = np.argsort(-bounds, axis=0, kind="stable")
            ranked = np.take_along_axis(bounds, order, axis=0)
            known: dict[tuple[int, int], int] = {}
            open_items = np.arange(len(block.items))
            for rank in range(len(order)):
                thresholds = np.fromiter((best[i].threshold for i in open_items), np.int64, len(open_items))
                open_items = open_items[ranked[rank, open_items] >= thresholds]
                if not len(open_items):
                    break
                wanted: dict[int, list[int]] = {}
                for item in open_items:
                    wanted.setdefault(int(order[rank, item]), []).append(int(item))
                for doc, asking in wanted.items():
                    if (doc, asking[0]) not in known:
                        reached = np.fromiter((best[i].threshold for i in range(len(best))), np.int64, len(best))
                        likely = np.flatnonzero(bounds[doc] >= reached)
                        values = block.scores(part["terms"][doc], part["tfs"][doc], int(lengths[doc]), likely)
                        known.update(zip(((doc, int(i)) for i in likely), values))
                    for item in asking:
                        score = known[doc, item]
                        if score > 0:
                            best[item].add(score, part["doc_id"][doc])
    for item, found in zip(block.items, best):
        for score, doc in found.rows():
            yield item, doc, score


def item_blocks(weighted: DataFrame) -> Iterator[list]:
    """The items' terms in blocks of at most ``BLOCK_TERMS`` rows, or one item; one block is on the driver at a time."""
    sizes = weighted.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    part = F.spark_partition_id()
    parts = stage(sizes.select("item", "n", part.alias("part")), "item-sizes")
    before = parts.groupBy("part").agg(F.sum("n").alias("total"))
    before = before.select(
        "part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("offset")
    )  # one row per task
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("item"))
    placed = parts.withColumn("reach", inside).join(F.broadcast(before), "part")
    numbered = placed.select("item", F.floor((F.col("offset") + F.col("reach") - 1) / BLOCK_TERMS).alias("block"))
    rows = stage(weighted.join(numbered, "item"), "item-blocks")
    last = rows.agg(F.max("block")).first()[0]
    for block in range(0 if last is None else last + 1):
        found = rows.filter(F.col("block") == block).select("item", "term", "tf", "weight").collect()
        if found:
            yield found


def ranked_documents(
    docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", item_key: str = "item_id", text: str = "text"
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``top`` best documents with a score above 0.

    Every document is bounded for every item, in blocks of items; only documents whose bound reaches the last score
    that counts are scored, and each part passes on at most ``top`` documents an item. Equal scores rank by
    ``doc_id``, NULL last. A NULL or empty text has no terms. Repeated documents each take a rank, repeated items
    are answered once, and items of one id with different texts each have ranks of their own. Empty tables give
    no rows. ``key`` must be an integer column. Columns other than the keys and texts are not read.
    """
    spark = docs.sparkSession
    index = search_index(docs, key, text)
    entries = index.filter(F.col("n").isNotNull())
    measured = entries.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    documents, total = measured["documents"], measured["terms"] or 1
    weighted = stage(weighted_items(item_terms(items, item_key, text), index, documents), "weighted-items")
    names = weighted.select("item", "item_id").distinct()
    found = None
    for rows in item_blocks(weighted):
        shared = spark.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            block = Block(shared.value)
            answers = list(search_part(batches, block, total, documents, top))
            if answers:
                columns = list(zip(*answers))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"]
                )

        sketches = entries.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "sketch", "terms", "tfs")
        with batches_of(spark, BATCH_ROWS):
            answers = stage(sketches.mapInArrow(run, "item long, doc_id long, score long"), "answers")
        shared.destroy()
        found = answers if found is None else found.unionByName(answers)
    if found is None:
        found = spark.createDataFrame([], "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


# The same ranking by scoring every document.
ORACLE_SQL = rf"""
with texts as (
  select row_number() over () as row, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM.pattern}') as terms from documents),
sized as (select row, doc_id, terms, len(terms) as n from texts where len(terms) > 0),
whole as (select count(*)::bigint as documents, sum(n)::bigint as total from sized),
counted as (
  select row, term, count(*)::bigint as tf from (select row, unnest(terms) as term from sized) group by row, term),
weights as (
  select term, floor(1000.0::double * ln((2 * documents + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from counted, whole group by term, documents),
items as (
  select distinct item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM.pattern}') as terms from benchmark),
asked as (
  select item_id, item, term, count(*)::bigint as repeats
  from (select item_id, item, unnest(terms) as term from (select *, row_number() over () as item from items))
  group by item_id, item, term),
scored as (
  select item_id, item, s.row, s.doc_id,
    sum(repeats * w * (({SCALE} * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // total))))::bigint as score
  from asked join counted c using (term) join weights using (term) join sized s on s.row = c.row, whole
  group by item_id, item, s.row, s.doc_id),
ranked as (
  select *, row_number() over (partition by item order by score desc, doc_id nulls last) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= {TOP}
"""
