"""Profiling tables: missing cells, numeric summaries, frequencies, correlation.

Each operator is one aggregation over all its columns. The numeric ones reduce
to a single row of counters per partition before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.expressions import as_column, missing, to_number
from ..spec import DatasetSpec
from . import cleaning
from .entities import entity_behavior, entity_conflicts
from .locations import risk_patterns
from .quantiles import group_medians

# Relative rank error 1 / 10,000 of the medians in the report, which one scan gives.
MEDIAN_ACCURACY = 10_000


def _one_row_per_column(df: DataFrame, columns: Sequence[str], measures) -> DataFrame:
    """Aggregate everything in one pass, then list one row per profiled column."""
    aggregates = [agg.alias(f"{i}_{name}") for i, c in enumerate(columns) for name, agg in measures(c)]
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{name}").alias(name) for name, _ in measures(c)])
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def _rounded(col: Column, digits: int | None) -> Column:
    return col if digits is None else F.round(col, digits)


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None, sentinel: str = "None") -> DataFrame:
    """``(column, missing, total)``: NULL cells and cells whose text contains the marker."""
    columns = df.columns if columns is None else columns
    return _one_row_per_column(
        df, columns, lambda c: [("missing", F.count_if(missing(c, sentinel))), ("total", F.count(F.lit(1)))]
    )


def numeric_summary(df: DataFrame, columns: Sequence[str], digits: int | None = 2) -> DataFrame:
    """``(column, count, mean, stddev, min, max)`` of the non-NULL values."""

    def measures(c):
        x = as_column(c)
        return [
            ("count", F.count(x)),
            ("mean", _rounded(F.avg(x), digits)),
            ("stddev", _rounded(F.stddev_samp(x), digits)),
            ("min", _rounded(F.min(x), digits)),
            ("max", _rounded(F.max(x), digits)),
        ]

    return _one_row_per_column(df, columns, measures)


def category_frequency(df: DataFrame, columns: Sequence[str], digits: int | None = 2) -> DataFrame:
    """``(column, value, count, percentage)``, most frequent first within each column."""
    return (
        cleaning.label_shares(df, columns)
        .select(
            "column",
            "value",
            F.col("rows").alias("count"),
            _rounded(F.col("share") * 100, digits).alias("percentage"),
        )
        .orderBy("column", F.desc("count"), F.asc_nulls_last("value"))
    )


def numeric_moments(
    df: DataFrame, columns: Sequence[str], digits: int | None = None, accuracy: int | None = None
) -> DataFrame:
    """``(column, mean, stddev, min, max, median, skewness, kurtosis)``.

    Skewness and excess kurtosis are the population ones. The median is the
    exact lower one, searched in a few cheap scans. With ``accuracy`` it is an
    approximate one instead, of relative rank error ``1 / accuracy``, in a single
    scan that merges one digest per partition and column.
    """

    def measures(c):
        x = as_column(c)
        return [
            ("mean", _rounded(F.avg(x), digits)),
            ("stddev", _rounded(F.stddev_samp(x), digits)),
            ("min", _rounded(F.min(x), digits)),
            ("max", _rounded(F.max(x), digits)),
            *([] if accuracy is None else [("median", _rounded(F.percentile_approx(x, 0.5, accuracy), digits))]),
            ("skewness", _rounded(F.skewness(x), digits)),
            ("kurtosis", _rounded(F.kurtosis(x), digits)),
        ]

    moments = _one_row_per_column(df, columns, measures)
    if accuracy is not None:
        return moments
    whole = df.select(F.lit(0).alias("__all"), *[as_column(c) for c in columns])
    medians = group_medians(whole, "__all", columns, lower=True)
    listed = medians.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column"), _rounded(as_column(c), digits).alias("median")) for c in columns]
            )
        )
    )
    # Both sides have one row per profiled column.
    return moments.join(F.broadcast(listed), "column").select(
        "column", "mean", "stddev", "min", "max", "median", "skewness", "kurtosis"
    )


# Columns whose sums with another column are one row's aggregates: few enough that Spark compiles them in one loop.
BLOCK = 4


def pair_sums(numbers: DataFrame, width: int) -> DataFrame:
    """``at`` and ``pairs``: masked sums of column ``i`` with a block of columns, ``at`` = i * blocks + block.

    A pair has, over the rows where both cells are present, their number ``n``, the sums ``x`` and ``xx`` of column i's
    values and squares, ``xy`` of the products, and column i's ends ``low`` and ``high``. Every row is listed once per column and
    block and combined before the shuffle, which moves one row per task, column and block. The plan has the size of a
    block, whatever the number of columns.
    """
    blocks = -(-width // BLOCK)
    values = numbers.select(F.array(*[F.col(f"x{j}") for j in range(width)]).alias("v"))
    placed = values.select("v", F.explode(F.sequence(F.lit(0), F.lit(width * blocks - 1))).alias("at"))
    first = F.expr(f"(at % {blocks}) * {BLOCK}")
    rows = placed.select(
        "at", F.get("v", F.expr(f"at div {blocks}").cast("int")).alias("x"),
        *[F.get("v", (first + k).cast("int")).alias(f"y{k}") for k in range(BLOCK)],
    )
    aggregates = []
    for k in range(BLOCK):
        x = F.when(F.col(f"y{k}").isNotNull(), F.col("x"))
        product = F.col("x") * F.col(f"y{k}")
        found = {"n": F.count(product), "x": F.sum(x), "xx": F.sum(x * x), "xy": F.sum(product), "low": F.min(x), "high": F.max(x)}
        aggregates += [value.alias(f"{name}{k}") for name, value in found.items()]
    sums = rows.groupBy("at").agg(*aggregates)
    pairs = [F.struct(*[F.col(f"{name}{k}").alias(name) for name in ("n", "x", "xx", "xy", "low", "high")]) for k in range(BLOCK)]
    return sums.select("at", F.array(*pairs).alias("pairs"))


def correlation_matrix(df: DataFrame, columns: Sequence[str], digits: int | None = None) -> DataFrame:
    """Pearson correlations, one row per column, one column per column.

    Each pair uses the rows where both cells are present. A pair with a constant
    side is NULL. Sums of squares are taken around the columns' means, which a first scan gives, so large values do
    not cancel out.
    """
    width = len(columns)
    blocks = -(-width // BLOCK)
    numbers = df.select(*[to_number(c).alias(f"x{j}") for j, c in enumerate(columns)])
    means = numbers.agg(*[F.avg(f"x{j}").alias(f"m{j}") for j in range(width)])  # one row
    centred = numbers.join(F.broadcast(means)).select(*[(F.col(f"x{j}") - F.col(f"m{j}")).alias(f"x{j}") for j in range(width)])
    sums = pair_sums(centred, width)
    # One row: all sums in order of ``at``, of which there are as many as columns times blocks.
    matrix = sums.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "pairs"))), lambda s: s["pairs"]).alias("m"))

    def cell(i: Column, j: Column) -> Column:
        return F.get(F.get("m", i * blocks + F.floor(j / BLOCK).cast("int")), j % BLOCK)

    def correlation(a: Column, b: Column) -> Column:
        spread = (a["n"] * a["xx"] - a["x"] * a["x"]) * (a["n"] * b["xx"] - b["x"] * b["x"])
        value = F.try_divide(a["n"] * a["xy"] - a["x"] * b["x"], F.sqrt(F.greatest(spread, F.lit(0.0))))
        varies = (a["low"] < a["high"]) & (b["low"] < b["high"])
        return _rounded(F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))), digits)

    named = matrix.select("m", F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("i", "column"))
    both = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.struct(cell(F.col("i"), j).alias("a"), cell(j, F.col("i")).alias("b")))
    rows = named.select("column", F.transform(both, lambda p: correlation(p["a"], p["b"])).alias("r"))
    return rows.select("column", *[F.get("r", F.lit(j)).alias(c) for j, c in enumerate(columns)])


def _observed_measures(spec: DatasetSpec) -> dict[str, tuple[str, str, Column]]:
    """Data quality and moments of all columns as aggregates: by name, the column, the measure and its expression."""
    sentinel = spec.sentinels[0] if spec.sentinels else "None"
    found = {"total": ("", "total", F.count(F.lit(1)))}
    for i, c in enumerate(spec.columns):
        found[f"missing_{i}"] = (c, "missing", F.count_if(missing(c, sentinel)))
    for i, c in enumerate(spec.numeric):
        x = as_column(c)
        measures = {
            "count": F.count(x), "mean": F.avg(x), "stddev": F.stddev_samp(x), "min": F.min(x), "max": F.max(x),
            "median": F.percentile_approx(x, 0.5, MEDIAN_ACCURACY), "skewness": F.skewness(x), "kurtosis": F.kurtosis(x),
        }
        found |= {f"{m}_{i}": (c, m, e) for m, e in measures.items()}
    return found


def observed_quality(df: DataFrame, spec: DatasetSpec) -> tuple[DataFrame, Callable[[int], dict[str, DataFrame]]]:
    """``df`` as it is, and a function that gives three sections of its profile once ``df`` has been written.

    The sections (missing cells, numeric summary, moments with the approximate median) are gathered while the rows
    pass by on their way to storage, so they cost no scan. Write ``df`` straight from its scan: the rows of a task
    that ran twice then count once, and each task hands over one row of counters. The driver gets one value per column and measure.
    """
    measures = _observed_measures(spec)
    observation = Observation()
    watched = df.observe(observation, *[expression.alias(name) for name, (_, _, expression) in measures.items()])

    def sections(digits: int = 2) -> dict[str, DataFrame]:
        values = observation.get
        by_column = {c: {m: values[name] for name, (of, m, _) in measures.items() if of == c} for c in spec.columns}

        def listed(columns, names, kinds, rounded):
            rows = [(c, *[by_column[c][n] for n in names]) for c in columns]
            schema = "column string, " + ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
            table = df.sparkSession.createDataFrame(rows, schema)
            return table.withColumns({n: F.round(n, digits) for n in rounded})

        for cells in by_column.values():
            cells["total"] = values["total"]
        basic, shape = ["mean", "stddev", "min", "max"], ["median", "skewness", "kurtosis"]
        return {
            "missing_counts": listed(spec.columns, ["missing", "total"], ["long", "long"], []),
            "numeric_summary": listed(spec.numeric, ["count", *basic], ["long"] + ["double"] * 4, basic),
            "numeric_moments": listed(spec.numeric, [*basic, *shape], ["double"] * 7, []),
        }

    return watched, sections


def report_sections(df: DataFrame, spec: DatasetSpec, digits: int = 2) -> dict[str, Callable[[], DataFrame]]:
    """A builder for each section of the profile of a cleaned transaction table.

    Pass a stored table: each section is a scan of its own over a few columns.
    """
    numeric = list(spec.numeric)
    sentinel = spec.sentinels[0] if spec.sentinels else "None"
    return {
        "missing_counts": lambda: missing_counts(df, list(spec.columns), sentinel),
        "numeric_summary": lambda: numeric_summary(df, numeric, digits),
        "category_frequency": lambda: category_frequency(df, list(spec.profiled_categories), digits),
        "numeric_moments": lambda: numeric_moments(df, numeric, accuracy=MEDIAN_ACCURACY),
        "risk_patterns": lambda: risk_patterns(df, spec),
        "entity_behavior": lambda: entity_behavior(df, spec),
        "entity_conflicts": lambda: entity_conflicts(df, spec.entity, list(spec.entity_columns)),
        "correlation_matrix": lambda: correlation_matrix(df, numeric, digits=6),
    }


def profile_report(df: DataFrame, spec: DatasetSpec, digits: int = 2) -> dict[str, DataFrame]:
    """All sections of the profile, by name."""
    return {name: build() for name, build in report_sections(df, spec, digits).items()}
