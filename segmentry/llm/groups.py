"""Groups of linked rows: bucket candidates without all pairs, and connected components."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage, stage_alone, staged_meanwhile

MAX_ROUNDS = 60
OPEN_ROWS = 4_000_000  # of open buckets, joined at once


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id) of every id in the links ``a``, ``b`` that is not the smallest.

    Each round ties every node's larger neighbours to its smallest one, then its
    smaller ones, until all links lead straight to a smallest id. Rounds grow with
    the logarithm of the longest chain. All steps are aggregates and joins on
    stored tables; the driver sees three counts a round.
    """
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    links = stage(edges.select(low, high).filter("low < high").distinct(), "links")
    for _ in range(MAX_ROUNDS):
        heads = links.select(F.col("low").alias("head")).distinct()
        chained = links.join(heads, F.col("high") == F.col("head"), "left_semi").limit(1).count()
        if not chained and not links.groupBy("high").count().filter("count > 1").limit(1).count():
            return links.select(F.col("high").alias("id"), F.col("low").alias("component"))
        both = links.select(F.col("high").alias("node"), F.col("low").alias("other")).union(links.select("low", "high"))
        smallest = both.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))
        larger = both.filter("other > node").join(smallest, "node").select("least", F.col("other").alias("high"))
        larger = larger.filter("least < high").distinct()
        below = larger.groupBy("high").agg(F.min("least").alias("low"))
        moved = larger.join(below, "high").select("low", F.col("least").alias("high"))
        links = stage(moved.union(below.select("low", "high")).filter("low < high").distinct(), "links")
    raise RuntimeError("components did not settle")


def bounded(table: DataFrame, rows: int = 500_000) -> DataFrame:
    """The stored, narrow table with a broadcast hint if it has at most ``rows`` rows; else Spark joins it by key."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def central_heads(members: DataFrame) -> DataFrame:
    """``key``, ``head``: of each bucket the member that shares the most buckets with others, and of these the smallest id.

    ``members`` is a table of ``id``, ``key`` and ``n``, the bucket's size. A text in the middle of a group of variants
    falls into more of their buckets than a variant at its edge.
    """
    centres = members.groupBy("id").agg(F.sum("n").alias("centre"))
    placed = members.join(centres, "id")
    return placed.groupBy("key").agg(F.max_by("id", F.struct("centre", -F.col("id"))).alias("head"))


def possible_pairs(pairs: DataFrame, described: DataFrame, possible: Callable[[str, str], Column]) -> DataFrame:
    """The pairs ``a``, ``b`` that may be linked by what ``described`` says of their ids; others have no link."""
    for x in ("a", "b"):
        side = described.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in described.columns if c != "id"])
        pairs = pairs.join(side, x)
    return pairs.filter(possible("a_", "b_")).select("a", "b")


def pairs_of_open(open_rows: DataFrame, described: DataFrame | None, possible: Callable[[str, str], Column] | None) -> DataFrame:
    """All possible pairs of different components that share an open bucket, each made once, in that of the least key.

    Each row needs all keys of its id for that. So that these do not lie on disk for the whole table at the same time, at most
    about ``OPEN_ROWS`` rows are joined at once, whole buckets of them.
    """
    ids = open_rows.groupBy("id").agg(F.collect_list("key").alias("keys"))
    ids = stage(ids.join(described, "id") if described is not None else ids, "open-ids")
    parts = max(1, -(-open_rows.count() // OPEN_ROWS))
    made = []
    for nth in range(parts):
        part = open_rows if parts == 1 else open_rows.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == nth)
        part = part.join(ids, "id")
        left, right = (part.select(*[F.col(c).alias(side + c) for c in part.columns]) for side in ("a_", "b_"))
        differ = (F.col("a_id") < F.col("b_id")) & (F.col("a_component") != F.col("b_component"))
        if possible:
            differ = differ & possible("a_", "b_")
        least = F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("a_key")
        crossing = left.join(right, (F.col("a_key") == F.col("b_key")) & differ & least)
        made.append(stage(crossing.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "pairs"))
    return reduce(DataFrame.union, made)


def linked_components(
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    describe: Callable[[DataFrame], DataFrame] | None = None,
    possible: Callable[[str, str], Column] | None = None,
    cross: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Components of all verified pairs that share a bucket, without trying all pairs of a bucket.

    ``buckets`` is a table of ``id`` and ``key`` (an id may repeat in a
    bucket); ``verify`` keeps the pairs ``a`` < ``b`` that are linked. First every member
    is tried against the bucket's smallest id. Pairs whose ends are then in one component
    cannot change the result; all others are tried. So a bucket that is one
    group of copies costs one pair per member, and no link between components is lost.
    ``describe`` adds columns to a table of ids, and may drop ids without any link.
    ``possible`` (given the prefixes of the two sides' columns) is false only for pairs that are not linked; they
    are never verified. A pair that shares several open buckets is made in that of the least key only.
    With ``cross``, members are tried against the bucket's most central one instead, and ``cross`` makes the pairs that are
    still to be tried: given the open ``id``, ``key`` and ``component``, all ``a`` < ``b`` of different components that
    can be linked.
    """
    spark = buckets.sparkSession

    def described(ids: DataFrame) -> DataFrame | None:
        return stage(describe(ids.select("id").distinct()), "described") if describe else None

    def spokes(members: DataFrame) -> DataFrame:
        tried = members.filter("id <> head").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct()
        return stage(possible_pairs(tried, described(members), possible), "pairs") if describe and possible else tried

    def open_pairs(rows: DataFrame) -> DataFrame:
        stored = stage(rows, "open-buckets")
        return pairs_of_open(stored, described(stored), possible)

    if cross:
        sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = stage(buckets.join(sizes, "key"), "bucket-sizes")
        rows = sized.drop("n").join(central_heads(sized), "key")
    else:
        ends = buckets.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("tail")).filter("head < tail")
        # Most keys have one row. Stored first, the heads free what finding them shuffled before all rows are shuffled again.
        rows = buckets.join(stage(ends.select("key", "head"), "bucket-heads"), "key")
    with staged_meanwhile(rows, "bucket-members") as members:
        linked = stage_alone(spark, lambda: verify(spokes(members)), "links-to-heads")
        grouped = stage_alone(spark, lambda: components(linked), "grouped")
        # Heads were tried against all members, so a bucket matters only if the others lie in several components.
        placed = members.filter("id <> head").join(grouped, "id", "left")
        placed = placed.select("key", "id", F.coalesce("component", "id").alias("component")).distinct()
        mixed = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
        open_rows = placed.join(mixed.filter("least < most").select("key"), "key")
        if cross:
            open_rows = stage(open_rows, "open-buckets")
        else:
            crossing = stage_alone(spark, lambda: open_pairs(open_rows), "pairs")
    more = stage_alone(spark, lambda: verify(cross(open_rows) if cross else crossing), "links-across")
    if not more.limit(1).count():
        return grouped
    # Links are lifted to the smallest ids, which keeps this graph small.
    lifted = (
        more.join(grouped.select(F.col("id").alias("a"), F.col("component").alias("a_root")), "a", "left")
        .join(grouped.select(F.col("id").alias("b"), F.col("component").alias("b_root")), "b", "left")
        .select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    )
    return components(grouped.select(F.col("component").alias("a"), F.col("id").alias("b")).union(lifted))
