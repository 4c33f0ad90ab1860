"""Queries for profiling, location windows and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cleaning, locations, profiling, sketches
from ..sources.staging import fresh_path, stage
from ..sources.tables import load_report, save_report
from ..spec import METRICS
from .catalog_cleaning import CLEANED_SQL
from .registry import query
from .retail import RETAIL, raw_transactions, table, transactions

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _each(columns, template: str) -> str:
    return " union all ".join(template.replace("{c}", c) for c in columns)


@query(
    "missing_counts",
    """with o as (select o_orderstatus, nullif(o_orderpriority, '4-NOT SPECIFIED') as o_orderpriority, o_totalprice
      from orders)
    select 'o_orderstatus' as "column", count(*) filter (o_orderstatus is null or contains(o_orderstatus, 'URGENT'))::bigint
      as missing, count(*)::bigint as total from o
    union all
    select 'o_orderpriority',
      count(*) filter (o_orderpriority is null or contains(o_orderpriority, 'URGENT'))::bigint, count(*)::bigint from o
    union all
    select 'o_totalprice', count(*) filter (o_totalprice is null)::bigint, count(*)::bigint from o""",
)
def missing_counts(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    orders = cleaning.sentinel_to_null(orders, ["4-NOT SPECIFIED"], ["o_orderpriority"])
    return profiling.missing_counts(orders, sentinel="URGENT")


@query(
    "numeric_summary",
    _each(
        LINE_NUMBERS,
        """select '{c}' as "column", count({c})::bigint as count, round(avg({c}), 6) as mean,
        round(stddev_samp({c}), 6) as stddev, min({c}) as min, max({c}) as max from lineitem""",
    ),
)
def numeric_summary(spark, folder):
    return profiling.numeric_summary(table(spark, folder, "lineitem"), LINE_NUMBERS, digits=6)


@query(
    "category_frequency",
    """with o as (select o_orderstatus, nullif(o_orderpriority, '4-NOT SPECIFIED') as o_orderpriority from orders)
    select 'o_orderstatus' as "column", o_orderstatus as value, count(*)::bigint as count,
      round(count(*) * 100.0::double / (select count(*) from o), 6) as percentage from o group by o_orderstatus
    union all
    select 'o_orderpriority', o_orderpriority, count(*)::bigint,
      round(count(*) * 100.0::double / (select count(*) from o), 6) from o group by o_orderpriority""",
)
def category_frequency(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority")
    orders = cleaning.sentinel_to_null(orders, ["4-NOT SPECIFIED"])
    return profiling.category_frequency(orders, ["o_orderstatus", "o_orderpriority"], digits=6)


@query(
    "numeric_moments",
    _each(
        LINE_NUMBERS,
        """select '{c}' as "column", round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as stddev,
        min({c}) as min, max({c}) as max, quantile_disc({c}, 0.5) as median,
        round(avg(power(({c} - mu) / sd, 3)), 6) as skewness, round(kurtosis_pop({c}), 6) as kurtosis
        from lineitem, (select avg({c}) as mu, stddev_pop({c}) as sd from lineitem)""",
    ),
)
def numeric_moments(spark, folder):
    return profiling.numeric_moments(table(spark, folder, "lineitem"), LINE_NUMBERS, digits=6)


@query(
    "numeric_moments_approx",
    _each(
        LINE_NUMBERS,
        """select '{c}' as "column", round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as stddev,
        min({c}) as min, max({c}) as max, true as median_in_bound,
        round(avg(power(({c} - mu) / sd, 3)), 6) as skewness, round(kurtosis_pop({c}), 6) as kurtosis
        from lineitem, (select avg({c}) as mu, stddev_pop({c}) as sd from lineitem)""",
    ),
)
def numeric_moments_approx(spark, folder):
    """With approximate medians: each one's rank must be within ``1 / accuracy`` of the middle."""
    accuracy = 10_000
    lines = table(spark, folder, "lineitem")
    moments = stage(profiling.numeric_moments(lines, LINE_NUMBERS, accuracy=accuracy), "moments")
    medians = {r["column"]: r["median"] for r in moments.select("column", "median").collect()}

    def in_bound(c):
        slack = F.ceil(F.count(c) / accuracy)  # ranks are whole numbers
        below, upto = F.count_if(F.col(c) < medians[c]), F.count_if(F.col(c) <= medians[c])
        return (below <= F.count(c) / 2 + slack) & (upto >= F.count(c) / 2 - slack)

    checks = lines.agg(*[in_bound(c).alias(c) for c in LINE_NUMBERS]).unpivot(
        [], LINE_NUMBERS, "column", "median_in_bound"
    )
    rounded = {c: F.round(c, 6) for c in ("mean", "stddev", "min", "max", "skewness", "kurtosis")}
    return moments.drop("median").withColumns(rounded).join(F.broadcast(checks), "column")


@query(
    "correlation_matrix",
    "with o as (select l_quantity, case when l_returnflag <> 'R' then l_extendedprice end as l_extendedprice, "
    "case when l_linestatus = 'F' then l_discount end as l_discount, l_tax from lineitem) "
    + " union all ".join(
        f"""select '{a}' as "column", """
        + ", ".join(f"round(corr({a}, {b}), 6) as {b}" for b in LINE_NUMBERS)
        + " from o"
        for a in LINE_NUMBERS
    ),
)
def correlation_matrix(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_quantity",
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(F.col("l_linestatus") == "F", F.col("l_discount")).alias("l_discount"),
        "l_tax",
    )
    return profiling.correlation_matrix(lines, LINE_NUMBERS, digits=6)


LOCATION_SQL = """
  select o_orderkey, c_nationkey, o_orderpriority,
    round(avg(o_totalprice) over (partition by c_nationkey), 6) as avg_transaction_by_location,
    count(o_totalprice) over (partition by c_nationkey)::bigint as transaction_frequency
  from orders join customer on c_custkey = o_custkey
"""


@query("location_window", LOCATION_SQL)
def location_window(spark, folder):
    rows = transactions(spark, folder).select("o_orderkey", "c_nationkey", "o_orderpriority", "o_totalprice")
    windowed = locations.location_window(rows, "c_nationkey", "o_totalprice").drop("o_totalprice")
    return windowed.withColumn("avg_transaction_by_location", F.round("avg_transaction_by_location", 6))


@query(
    "risk_score",
    """select o_orderkey, case o_orderpriority when '1-URGENT' then 3 when '2-HIGH' then 2 else 1 end as risk_score
    from orders""",
)
def risk_score(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return locations.risk_score(orders, "o_orderpriority", {"1-URGENT": 3, "2-HIGH": 2}).drop("o_orderpriority")


@query("hash_sample", "select o_orderkey, o_totalprice from orders where md5(o_orderkey::varchar) < '1999999a'")
def hash_sample(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return locations.hash_sample(orders, 0.1, ["o_orderkey"])


@query(
    "risk_patterns",
    f"""select c_nationkey, avg_transaction_by_location, transaction_frequency,
      case o_orderpriority when '1-URGENT' then 3 when '2-HIGH' then 2 else 1 end as risk_score
    from ({LOCATION_SQL}) where md5(o_orderkey::varchar) < '1999999a'""",
)
def risk_patterns(spark, folder):
    spec = RETAIL.with_(risk_scores={"1-URGENT": 3, "2-HIGH": 2})
    patterns = locations.risk_patterns(transactions(spark, folder), spec, 0.1, ["o_orderkey"])
    return patterns.withColumn("avg_transaction_by_location", F.round("avg_transaction_by_location", 6))


@query(
    "profile_sample",
    """select c_custkey, c_acctbal, c_mktsegment from customer
    order by md5(c_custkey::varchar), c_custkey limit 100""",
)
def profile_sample(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return locations.profile_sample(customers, 100, ["c_custkey"])


ALL_COLUMNS = list(RETAIL.columns)
MOMENTS = {
    "mean": "avg({c})",
    "stddev": "stddev_samp({c})",
    "min": "min({c})",
    "max": "max({c})",
    "skewness": "avg(({c} - {c}_mean) ** 3) / var_pop({c}) ** 1.5",
    "kurtosis": "avg(({c} - {c}_mean) ** 4) / var_pop({c}) ** 2 - 3",
}
BEHAVIOR = {
    "avg_transaction_amount": "avg(o_totalprice)",
    "transaction_count": "count(o_totalprice)",
    "cash_transactions": "count(*) filter (o_orderstatus = 'f')",
    "monthly_income": "max(c_acctbal)",
    "monthly_expenses": "max(o_totalprice)",
}


def _cell(section: str, column: str, metric: str, value: str, source: str = "o", group: str = "") -> str:
    return (
        f"select '{section}' as section, '{column}' as \"column\", {metric} as metric, "
        f"round(({value})::double, 3) as value from {source} {group}"
    )


OVERVIEW_SQL = (
    f"""with {CLEANED_SQL},
    o as (select *, avg(c_acctbal) over () as c_acctbal_mean, avg(o_totalprice) over () as o_totalprice_mean from prepared),
    b as (select c_custkey, {", ".join(f"{e} as {m}" for m, e in BEHAVIOR.items())} from prepared group by c_custkey)
    """
    + " union all ".join(
        [
            _cell("missing_counts", c, f"'{m}'", v.format(c=c))
            for c in ALL_COLUMNS
            for m, v in (("missing", "count(*) filter ({c} is null)"), ("total", "count(*)"))
        ]
        + [_cell("numeric_summary", c, "'count'", f"count({c})") for c in RETAIL.numeric]
        + [
            _cell(section, c, f"'{m}'", MOMENTS[m].format(c=c))
            for section, names in (("numeric_summary", list(MOMENTS)[:4]), ("numeric_moments", MOMENTS))
            for c in RETAIL.numeric
            for m in names
        ]
        + [
            _cell("category_frequency", c, f"coalesce({c}, 'NULL') || '{m}'", v, "o", f"group by {c}")
            for c in RETAIL.profiled_categories
            for m, v in ((" count", "count(*)"), (" percentage", "100.0::double * count(*) / (select count(*) from o)"))
        ]
        + [_cell("correlation_matrix", a, f"'{b}'", f"corr({a}, {b})") for a in RETAIL.numeric for b in RETAIL.numeric]
        + [_cell("entity_behavior", "c_custkey", "'entities'", "count(*)", "b")]
        + [_cell("entity_behavior", "c_custkey", f"'{m}'", f"sum({m})", "b") for m in BEHAVIOR]
        + [
            _cell(
                "entity_behavior", "c_custkey", "'income_expense_ratio'",
                "sum(monthly_income / nullif(monthly_expenses, 0))", "b",
            ),
            _cell("entity_conflicts", "c_custkey", "'entities'", "0", "(select 1)"),
        ]
    )
)


@query("profile_overview", OVERVIEW_SQL)
def profile_overview(spark, folder):
    """The stored report, flattened: every section, column and measure, but for two that other queries prove:
    the approximate median (``numeric_moments_approx``) and the listed sample (``risk_patterns``)."""
    cleaned = stage(cleaning.preprocess(raw_transactions(spark, folder), RETAIL), "cleaned")
    path = fresh_path(spark, "report")
    built = profiling.profile_report(cleaned, RETAIL, digits=6)
    save_report(built, path)
    report = load_report(spark, path, built)

    def cells(section, metrics, column=F.col("column"), prefix=None):
        listed = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metrics.items()])
        flat = report[section].select(column.alias("column"), *([prefix.alias("p")] if prefix is not None else []), F.inline(listed))
        metric = F.concat("p", F.lit(" "), F.col("metric")) if prefix is not None else F.col("metric")
        return flat.select(F.lit(section).alias("section"), "column", metric.alias("metric"), F.round("value", 3).alias("value"))

    def columns(*names):
        return {n: F.col(n) for n in names}

    key = F.lit(RETAIL.entity)
    behavior = {m: F.sum(m).alias(m) for m in METRICS} | {"entities": F.count(F.lit(1)).alias("entities")}
    report["entity_behavior"] = report["entity_behavior"].agg(*behavior.values())
    report["entity_conflicts"] = report["entity_conflicts"].agg(F.count(F.lit(1)).alias("entities"))
    parts = [
        cells("missing_counts", columns("missing", "total")),
        cells("numeric_summary", columns("count", "mean", "stddev", "min", "max")),
        cells("numeric_moments", columns(*MOMENTS)),
        cells("category_frequency", columns("count", "percentage"), prefix=F.coalesce("value", F.lit("NULL"))),
        cells("correlation_matrix", columns(*RETAIL.numeric)),
        cells("entity_behavior", columns(*behavior), key),
        cells("entity_conflicts", columns("entities"), key),
    ]
    return reduce(DataFrame.unionByName, parts)


# Columns of lines and their orders, some with gaps, as expressions that Spark and SQL read alike.
WIDE = {
    "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "line": "l_linenumber",
    "part": "l_partkey % 1000", "supplier": "l_suppkey", "total": "o_totalprice", "day": "o_orderkey % 365",
    "net": "l_extendedprice * (1 - l_discount)", "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
    "unit": "l_extendedprice / l_quantity", "share": "l_extendedprice / o_totalprice",
    "price_returned": "case when l_returnflag = 'R' then l_extendedprice end",
    "price_kept": "case when l_returnflag <> 'R' then l_extendedprice end",
    "discount_open": "case when l_linestatus = 'O' then l_discount end",
    "tax_first": "case when l_linenumber = 1 then l_tax end",
    "total_urgent": "case when o_orderpriority = '1-URGENT' then o_totalprice end",
    "large": "1000000000 + l_extendedprice", "squared": "l_quantity * l_quantity",
}


@query(
    "correlation_wide",
    "with o as (select "
    + ", ".join(f"({e})::double as {c}" for c, e in WIDE.items())
    + " from lineitem join orders on l_orderkey = o_orderkey) "
    + " union all ".join(
        f"""select '{a}' as "column", """
        + ", ".join(f"round(case when isfinite(corr({a}, {b})) then corr({a}, {b}) end, 6) as {b}" for b in WIDE)
        + " from o"
        for a in WIDE
    ),
)
def correlation_wide(spark, folder):
    """Twenty columns, gaps that leave pairs without a common row, and one with a large offset."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    numbers = lines.select(*[F.expr(e).cast("double").alias(c) for c, e in WIDE.items()])
    return profiling.correlation_matrix(stage(numbers, "wide"), list(WIDE), digits=6)


@query(
    "merged_quantiles",
    " union all ".join(
        f"""select l_returnflag as "group", '{c}' as "column", count({c})::bigint as rows, unnest([0.1, 0.5, 0.9])::double as rank,
        true as in_bound from lineitem group by l_returnflag"""
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def merged_quantiles(spark, folder):
    """Sketches of two halves of the lines, stored one after the other and merged; each value's exact rank must be in bound."""
    lines, path, columns = table(spark, folder, "lineitem"), fresh_path(spark, "sketches"), ["l_quantity", "l_extendedprice"]
    for half in (0, 1):
        part = lines.filter(F.col("l_orderkey") % 2 == half)
        sketches.quantile_sketches(part, columns, "l_returnflag").write.mode("append").parquet(path)
    merged = sketches.merge_sketches(spark.read.parquet(path))
    found = stage(sketches.sketch_quantiles(merged, [0.1, 0.5, 0.9]), "quantiles")
    cells = lines.select(
        F.col("l_returnflag").alias("group"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in columns])),
    )
    # Three rows per group and column.
    ranked = cells.join(F.broadcast(found), ["group", "column"]).groupBy("group", "column", "rows", "rank").agg(
        F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto")
    )
    slack = F.col("rows") * sketches.RANK_ERROR + 1
    wanted = F.col("rank") * F.col("rows")
    bound = (F.col("below") <= wanted + slack) & (F.col("upto") >= wanted - slack)
    return ranked.select("group", "column", "rows", "rank", bound.alias("in_bound"))


OBSERVED_SQL = (
    f"with {CLEANED_SQL}, o as (select *, avg(c_acctbal) over () as c_acctbal_mean, avg(o_totalprice) over () as o_totalprice_mean "
    "from cleaned) "
    + " union all ".join(
        [
            _cell("missing_counts", c, f"'{m}'", v.format(c=c))
            for c in ALL_COLUMNS
            for m, v in (("missing", "count(*) filter ({c} is null)"), ("total", "count(*)"))
        ]
        + [_cell("numeric_summary", c, "'count'", f"count({c})") for c in RETAIL.numeric]
        + [
            _cell(section, c, f"'{m}'", MOMENTS[m].format(c=c))
            for section, names in (("numeric_summary", list(MOMENTS)[:4]), ("numeric_moments", MOMENTS))
            for c in RETAIL.numeric
            for m in names
        ]
    )
)


@query("observed_quality", OBSERVED_SQL)
def observed_quality(spark, folder):
    """Three sections of the report gathered while the typed table is written, without a scan of their own."""
    watched, sections = profiling.observed_quality(cleaning.clean_columns(raw_transactions(spark, folder), RETAIL), RETAIL)
    stage(watched, "typed")
    found = sections(6)
    parts = []
    for name, table_ in found.items():
        metrics = [c for c in table_.columns if c not in ("column", "median")]
        cells = table_.select("column", *[F.col(m).cast("double").alias(m) for m in metrics])
        flat = cells.unpivot("column", metrics, "metric", "value")
        parts.append(flat.select(F.lit(name).alias("section"), "column", "metric", F.round("value", 3).alias("value")))
    return reduce(DataFrame.unionByName, parts)
