"""Exact medians per group without collecting a group into one task.

Spark's ``median`` keeps every distinct value of a group in one buffer. Here the middle is
bracketed by rank: a scan takes the quantiles inside each group's bracket on a
fixed grid, counts exactly what lies below and inside, and the bracket closes in
on the wanted ranks. Each scan leaves about a hundredth of the rows inside,
whatever the values are like. Then the values inside are counted one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import as_column, to_number
from ..sources.staging import stage

GRID = 1_000
ACCURACY = 10 * GRID
MARGIN = 4  # grid steps on each side of the wanted ranks: their error is far below one step
# Values of a group that a last scan counts one by one; brackets close in until no more can be inside.
COUNTED_VALUES = 10_000


def group_medians(df: DataFrame, group: str, columns: Sequence[str], lower: bool = False) -> DataFrame:
    """Exact median of each column per group, one row per group.

    NULL and NaN cells are ignored. For an even number of values the median is
    the mean of the two middle ones, or the smaller of them with ``lower``. The state, one
    row per group and column, is a stored table joined by key; the number of groups is free.
    """
    numbers = df.select(as_column(group).alias("g"), *[to_number(c).alias(f"x{i}") for i, c in enumerate(columns)])
    listed = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"x{i}").alias("v")) for i in range(len(columns))])
    cells = numbers.select("g", F.inline(listed)).filter(F.col("v").isNotNull())

    sizes = cells.groupBy("g", "f").agg(F.count(F.lit(1)).alias("n"))
    no_bound = F.lit(None).cast("double")
    state = stage(
        sizes.select(
            "g",
            "f",
            F.expr("(n + 1) div 2").alias("first"),
            (F.expr("(n + 1) div 2") if lower else F.expr("n div 2 + 1")).alias("last"),
            no_bound.alias("low"),
            no_bound.alias("high"),
            F.col("n").alias("inside"),
        ),
        "median-ranks",
    )
    inside = state.agg(F.max("inside")).first()[0] or 0
    while inside > COUNTED_VALUES:
        state = stage(_narrowed(_in_bracket(cells, state)), "median-brackets")
        inside = inside * (2 * MARGIN + 3) // GRID  # ties can only mean fewer distinct values
    found = _middle(_in_bracket(cells, state))

    groups = numbers.select("g").distinct()
    wide = found.groupBy("g").agg(*[F.max(F.when(F.col("f") == i, F.col("median"))).alias(f"m{i}") for i in range(len(columns))])
    named = wide.select(F.col("g").alias("k"), *[F.col(f"m{i}").alias(c) for i, c in enumerate(columns)])
    joined = groups.join(named, F.col("g").eqNullSafe(F.col("k")), "left")
    return joined.select(F.col("g").alias(group), *[as_column(c) for c in columns])


def _in_bracket(cells: DataFrame, state: DataFrame) -> DataFrame:
    """Cells up to the bracket of their group and column, the ones below it with a NULL value."""
    bounds = state.withColumnsRenamed({"g": "sg", "f": "sf"})
    joined = cells.join(bounds, F.col("g").eqNullSafe(F.col("sg")) & (F.col("f") == F.col("sf")))
    kept = joined.filter(F.col("high").isNull() | (F.col("v") <= F.col("high")))
    value = F.when(F.col("low").isNull() | (F.col("v") >= F.col("low")), F.col("v"))
    return kept.select("g", "f", "first", "last", value.alias("v"))


def _narrowed(cells: DataFrame) -> DataFrame:
    """One scan: the grid steps around the wanted ranks become the new bracket."""
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    counted = cells.groupBy("g", "f").agg(
        F.first("first").alias("first"),
        F.first("last").alias("last"),
        F.count_if(F.col("v").isNull()).alias("below"),
        F.count("v").alias("inside"),
        F.percentile_approx("v", grid, ACCURACY).alias("steps"),
    )

    def step(rank: str, margin: int) -> Column:
        at = F.floor((F.col(rank) - F.col("below")) * GRID / F.col("inside")).cast("int") + margin
        return F.get("steps", F.greatest(F.lit(0), F.least(F.lit(GRID), at)))

    return counted.select("g", "f", "first", "last", step("first", -MARGIN).alias("low"), step("last", MARGIN + 1).alias("high"))


def _middle(cells: DataFrame) -> DataFrame:
    """The median from the counts of the distinct values inside the bracket."""
    counts = cells.groupBy("g", "f", "v").agg(
        F.count(F.lit(1)).alias("n"), F.first("first").alias("first"), F.first("last").alias("last")
    )
    upto = F.sum("n").over(Window.partitionBy("g", "f").orderBy(F.asc_nulls_first("v")))
    ranked = counts.withColumn("upto", upto)

    def at(rank: str) -> Column:
        return F.min(F.when(F.col("upto") >= F.col(rank), F.col("v")))

    picked = ranked.groupBy("g", "f").agg(at("first").alias("a"), at("last").alias("b"))
    median = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") / 2 + F.col("b") / 2)
    return picked.select("g", "f", median.alias("median"))
