"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import as_column
from ..sources.staging import stage
from .batches import slices
from .groups import bounded, linked_components

WORD = re.compile(r"\w+")
BATCH_BYTES = 4 << 20
U64 = np.uint64


@dataclass(frozen=True)
class NearRules:
    """Production parameters: 36 bands of 7 registers find a pair of similarity 0.8 with probability 0.9998."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 36
    rows: int = 7


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64): every input bit changes about half of the output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def weighted_shingles(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted by text and hash: text number, 64-bit hash, weight (its count).

    Words are lower-cased runs of letters, digits and underscores. A text of fewer words than a
    shingle has one shingle of all its words; a text without words has none.
    """
    lists = [WORD.findall(t.lower()) if t else [] for t in texts]
    flat = pa.array([w for found in lists for w in found], pa.string()).dictionary_encode()
    codes = np.fromiter(
        (xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()), U64, len(flat.dictionary)
    )
    hashes = codes[flat.indices.to_numpy()] if len(flat) else np.zeros(0, U64)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    starts = np.cumsum(sizes) - sizes
    counts = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(lists)), counts)
    first = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    value = np.zeros(len(first), U64)
    last = (starts + sizes)[owner]
    for i in range(words):
        inside = first + i < last
        value[inside] = mixed(value[inside] + hashes[first[inside] + i] + U64(i + 1))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(owner)))


def prob_minhash(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """One row of registers per text; two registers agree with the probability Jaccard similarity.

    Every shingle is a Poisson process whose rate is its weight, and each arrival hits a
    register picked at random; a register keeps the shingle that arrives first. The processes
    depend on the shingle alone. A shingle stops once it is later than all registers of its text.
    """
    times = np.full(texts * registers, np.inf)
    keeps = np.zeros(texts * registers, U64)
    clock = np.zeros(len(shingle))
    rate = weight.astype(float)
    arrival = 0
    while len(shingle):
        arrival += 1
        draw = mixed(shingle + U64((0x9E3779B97F4A7C15 * arrival) & 0xFFFFFFFFFFFFFFFF))
        clock = clock - np.log(((draw >> U64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        hit = owner * registers + (mixed(draw) % U64(registers)).astype(np.int64)
        early = clock < times[hit]
        slot, when, what = hit[early], clock[early], shingle[early]
        np.minimum.at(times, slot, when)
        first = times[slot] == when
        keeps[slot[first]] = what[first]
        going = clock < times.reshape(texts, registers).max(axis=1)[owner]
        owner, shingle, rate, clock = owner[going], shingle[going], rate[going], clock[going]
    return keeps.reshape(texts, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), U64) + np.arange(1, bands + 1, dtype=U64)
    for i in range(rows):
        keys = mixed(keys + signature[:, i::rows][:, :bands])
    return keys.astype(np.int64)


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weight vectors over the same shingles."""
    total = 0.0
    both = np.flatnonzero((a > 0) & (b > 0))
    pairs, counts = np.unique(np.stack([a[both], b[both]]), axis=1, return_counts=True)
    for (x, y), n in zip(pairs.T, counts):
        total += n / np.maximum(a / x, b / y).sum()
    return total


def similar_pairs(lefts: list[str], rights: list[str], rules: NearRules) -> np.ndarray:
    """Which pairs reach the similarity: plain Jaccard of the shingle sets, or probability Jaccard of the weights."""
    n = len(lefts)
    owner, shingle, weight = weighted_shingles(lefts + rights, rules.words)
    pair, right = owner % n, owner >= n
    order = np.lexsort((right, shingle, pair))
    pair, shingle, weight, right = pair[order], shingle[order], weight[order], right[order]
    same = np.zeros(len(pair), bool)
    same[1:] = (pair[1:] == pair[:-1]) & (shingle[1:] == shingle[:-1])
    shared = np.bincount(pair[same], minlength=n)
    union = np.bincount(pair, minlength=n) - shared
    found = shared >= rules.similarity * np.maximum(union, 1)
    found &= union > 0
    repeated = np.bincount(pair[weight > 1], minlength=n) > 0
    for i in np.flatnonzero(~found & repeated & (shared > 0)):
        mine = slice(*np.searchsorted(pair, [i, i + 1]))
        _, code = np.unique(shingle[mine], return_inverse=True)
        side, w = right[mine], weight[mine].astype(float)
        a = np.bincount(code[~side], w[~side], code.max() + 1)
        b = np.bincount(code[side], w[side], code.max() + 1)
        found[i] = probability_jaccard(a, b) >= rules.similarity
    return found


def signatures(docs: DataFrame, rules: NearRules) -> DataFrame:
    """``doc_id``, ``raw`` (digest of the text), ``words`` (digest of its word sequence, NULL without words), ``bands``."""
    source = docs.select("doc_id", "text", F.md5(F.col("text")).alias("raw"))
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("raw", T.StringType()),
            T.StructField("words", T.StringType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                texts = part.column(1).to_pylist()
                keys = [" ".join(WORD.findall(t.lower())) if t else "" for t in texts]
                digests = [xxhash.xxh128_hexdigest(k) if k else None for k in keys]
                signature = prob_minhash(*weighted_shingles(texts, rules.words), len(texts), rules.bands * rules.rows)
                bands = band_keys(signature, rules.bands, rules.rows)
                empty = np.array([d is None for d in digests])
                offsets = pa.array(np.arange(len(texts) + 1) * rules.bands, pa.int32(), mask=np.append(empty, False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(bands.ravel()))
                columns = [part.column(0), part.column(2), pa.array(digests, pa.string()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, rules: NearRules) -> DataFrame:
    """The pairs ``a``, ``b`` whose texts (``id``, ``text``) reach the similarity."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
    source = pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")
    schema = pairs.select("a", "b").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in slices(batch, 2, BATCH_BYTES):
                for part in slices(half, 3, BATCH_BYTES):
                    found = similar_pairs(part.column(2).to_pylist(), part.column(3).to_pylist(), rules)
                    yield part.select(["a", "b"]).filter(pa.array(found))

    return source.mapInArrow(run, schema)


def shingled(texts: DataFrame, rules: NearRules) -> DataFrame:
    """``id``, ``shingle`` and its weight ``w``, one row per distinct shingle of each text."""
    fields = [T.StructField("shingle", T.LongType()), T.StructField("w", T.LongType())]
    schema = T.StructType([texts.schema["id"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                owner, shingle, weight = weighted_shingles(part.column(1).to_pylist(), rules.words)
                columns = [part.column(0).take(pa.array(owner)), pa.array(shingle.astype(np.int64)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return texts.select("id", "text").mapInArrow(run, schema)


def can_be_similar(a: str, b: str, similarity: float) -> Column:
    """Whether two texts' counts leave room for the similarity: only shared shingles can be common.

    That bounds the Jaccard similarity of the sets, and the probability Jaccard by the share of either text's
    weight; the second only matters where a shingle repeats."""
    common = F.least(F.col(a + "shared"), F.col(b + "shared"))
    plain = common >= similarity * (F.col(a + "size") + F.col(b + "size") - common)
    repeats = (F.col(a + "weight") > F.col(a + "size")) | (F.col(b + "weight") > F.col(b + "size"))
    weighted = [F.col(x + "shared_weight") >= similarity * F.col(x + "weight") - 1e-9 for x in (a, b)]
    return plain | (repeats & weighted[0] & weighted[1])


def crossing_pairs(open_rows: DataFrame, texts: DataFrame, bands: DataFrame, rules: NearRules) -> DataFrame:
    """The pairs ``a`` < ``b`` of open texts in different components that share a band and can be similar.

    A prefix filter, which loses no pair: each text's shingles are ordered from the rarest among the open texts to the most
    frequent. Behind the first shingle that two similar texts share, both must still hold enough for the similarity, so
    it stands in the first fifth of both. Texts that have only a template in common share no rare shingle and never meet.
    """
    ids = stage(open_rows.select("id", "component").distinct(), "open-ids")
    found = stage(shingled(texts.join(ids.select("id"), "id"), rules), "open-shingles")
    met = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stage(found.join(met, "shingle"), "open-shared")
    sizes = found.groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.sum("w").alias("weight"))
    counts = shared.groupBy("id").agg(F.count(F.lit(1)).alias("shared"), F.sum("w").alias("shared_weight"))
    counts = sizes.join(counts, "id").join(ids, "id")
    enough = F.greatest(F.col("shared") / F.col("size"), F.col("shared_weight") / F.col("weight"))
    counts = stage(counts.filter(enough >= rules.similarity - 1e-9), "open-counts")

    rarest = Window.partitionBy("id").orderBy("n", "shingle")
    before = rarest.rowsBetween(Window.unboundedPreceding, -1)
    lost = F.col("weight") - F.col("shared_weight") + F.coalesce(F.sum("w").over(before), F.lit(0))
    # Shingles that no other open text has come first of all; they are counted and need no row.
    at = F.col("size") - F.col("shared") + F.row_number().over(rarest) - 1
    placed = shared.join(counts, "id").withColumns({"at": at, "lost": lost})
    spare = 1 - rules.similarity
    prefix = (F.col("at") <= spare * F.col("size") + 1e-6) | (F.col("lost") <= spare * F.col("weight") + 1e-6)
    kept = "id component shingle at lost size weight shared shared_weight".split()
    prefixes = stage(placed.filter(prefix).select(*kept), "open-prefixes")
    left, right = (prefixes.select(*[F.col(c).alias(side + c) for c in kept]) for side in ("a_", "b_"))
    differ = (F.col("a_id") < F.col("b_id")) & (F.col("a_component") != F.col("b_component"))
    share = rules.similarity / (1 + rules.similarity)
    rest = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    plain = rest >= share * (F.col("a_size") + F.col("b_size")) - 1e-6
    repeats = (F.col("a_weight") > F.col("a_size")) | (F.col("b_weight") > F.col("b_size"))
    weighted = [F.col(x + "lost") <= spare * F.col(x + "weight") + 1e-6 for x in ("a_", "b_")]
    ahead = plain | (repeats & weighted[0] & weighted[1])
    same = F.col("a_shingle") == F.col("b_shingle")
    pairs = left.join(right, same & differ & ahead & can_be_similar("a_", "b_", rules.similarity))
    pairs = pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(bands.select(F.col("id").alias(side), F.col("bands").alias(f"{side}_bands")), side)
    return pairs.filter(F.arrays_overlap("a_bands", "b_bands")).select("a", "b")


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", rules: NearRules | None = None
) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (smallest doc_id of its class), ``class_size``, ``kept``, ``raw``.

    Classes are the components of all pairs whose five-word shingles reach a similarity of 0.8. Texts with
    the same word sequence are one class and are represented once in the search. Exactly one row of a
    class is kept: the smallest key, and of rows that repeat it the first one. NULL, empty and wordless
    texts are compared with nothing and stay, each as a class of its own. ``raw`` is the digest of the text.
    """
    rules = rules or NearRules()
    docs = df.select(as_column(key).alias("doc_id"), as_column(text).alias("text"))
    rows = stage(signatures(docs, rules).withColumn("row", F.monotonically_increasing_id()), "near-signatures")

    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    distinct = (
        rows.filter(F.col("words").isNotNull())
        .groupBy("words")
        .agg(
            F.min(rank).alias("first"),
            F.min_by("raw", rank).alias("raw"),
            F.first("bands").alias("bands"),
            F.count(F.lit(1)).alias("copies"),
        )
        .withColumn("id", F.monotonically_increasing_id())
    )
    distinct = stage(distinct, "near-distinct")
    buckets = stage(
        distinct.select("id", F.explode("bands").alias("key")),
        "near-buckets",
    )
    shared = buckets.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    needed = buckets.join(shared.select("key"), "key", "left_semi").select("id").distinct()
    wanted = stage(distinct.join(needed, "id").select("id", "raw", F.col("first.doc_id").alias("doc_id")), "near-wanted")
    source = docs.withColumn("raw", F.md5("text")).alias("s").join(
        bounded(wanted).alias("w"),
        (F.col("s.raw") == F.col("w.raw")) & F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")),
    )
    texts = stage(source.groupBy("id").agg(F.first("text").alias("text")), "near-texts")


    grouped = linked_components(
        buckets,
        lambda pairs: verified(pairs, texts, rules),
        cross=lambda open_rows: crossing_pairs(open_rows, texts, distinct, rules),
    )
    placed = distinct.join(grouped, "id", "left").select(
        "words", "first", "copies", F.coalesce("component", "id").alias("component")
    )
    classes = stage(placed, "near-classes")
    totals = classes.groupBy("component").agg(F.min("first").alias("first"), F.sum("copies").alias("size"))
    by_words = classes.select("words", "component").join(totals, "component").drop("component")
    return rows.join(by_words, "words", "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("size", F.lit(1)).alias("class_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        "raw",
    )


def drop_near_duplicates(docs: DataFrame, rules: NearRules | None = None) -> DataFrame:
    """``docs`` with one document of every class. The rows are stored once with a number to join on."""
    source = stage(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "near-docs")
    numbered = source.select(F.struct(F.col("doc.doc_id").alias("doc_id"), "row").alias("key"), "doc.text")
    gone = near_duplicates(numbered, "key", "text", rules).filter(~F.col("kept")).select("doc_id.row")
    kept = source.join(gone, "row", "left_anti")
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
