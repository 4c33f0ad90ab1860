"""Queries for incremental runs, bucketed and published tables, malformed files, and vocabularies of any size."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import vocabulary
from ..sources import tables
from ..sources.buckets import join_bucketed, store_bucketed
from ..sources.publish import publish, read_published
from ..sources.staging import fresh_path, stage
from .catalog_cleaning import CLEANED_SQL
from .incremental import History
from .registry import query
from .retail import RETAIL, raw_transactions, table

MEDIANS = {
    "o_orderstatus_f_median": "o_orderstatus = 'f'", "o_orderstatus_o_median": "o_orderstatus = 'o'",
    "o_orderpriority_1_urgent_median": "o_orderpriority = '1-urgent'", "o_orderpriority_none_median": "o_orderpriority is null",
}


def history(spark, folder, batches: int = 2) -> History:
    """The transactions written as CSV in batches, each taken in as soon as it is there."""
    source, taken = fresh_path(spark, "batches"), History(spark, fresh_path(spark, "history"), RETAIL)
    raw = raw_transactions(spark, folder)
    part = F.pmod(F.xxhash64(*raw.columns), F.lit(batches))
    for i in range(batches):
        raw.filter(part == i).write.option("header", True).mode("append").csv(source)
        taken.take_in(source)
    return taken


@query(
    "incremental_entities",
    f"""with {CLEANED_SQL},
    m as (select c_custkey, avg(o_totalprice) as avg_transaction_amount, count(o_totalprice)::bigint as transaction_count,
      count(*) filter (where o_orderstatus = 'f')::bigint as cash_transactions, max(c_acctbal) as monthly_income,
      max(o_totalprice) as monthly_expenses,
      {", ".join(f"median(coalesce({e}, false)::int)::double as {n}" for n, e in MEDIANS.items())}
      from prepared group by c_custkey)
    select c_custkey, c_mktsegment, c_nationkey, c_acctbal, round(avg_transaction_amount, 6) as avg_transaction_amount,
      transaction_count, cash_transactions, monthly_income, monthly_expenses,
      round(monthly_income / nullif(monthly_expenses, 0), 6) as income_expense_ratio, {", ".join(MEDIANS)}
    from (select distinct c_custkey, c_mktsegment, c_nationkey, c_acctbal from prepared) join m using (c_custkey)""",
)
def incremental_entities(spark, folder):
    """The entity table after two batches of files, the second run reading its own files only: the same as of one full run."""
    table_ = history(spark, folder).entities()
    names = {"o_orderpriority_1-urgent_median": "o_orderpriority_1_urgent_median", "o_orderpriority_None_median": "o_orderpriority_none_median"}
    rounded = {c: F.round(c, 6) for c in ("avg_transaction_amount", "income_expense_ratio")}
    return table_.withColumns(rounded).withColumnsRenamed(names)


@query(
    "incremental_quantiles",
    """select 'c_acctbal' as "column", count(c_acctbal)::bigint as rows, true as in_bound
      from orders join customer on c_custkey = o_custkey
    union all select 'o_totalprice', count(o_totalprice)::bigint, true from orders""",
)
def incremental_quantiles(spark, folder):
    """The medians over three batches from their sketches; each one's exact rank must be in bound."""
    found = stage(history(spark, folder, 3).quantiles(), "quantiles")
    raw = raw_transactions(spark, folder)
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in ("c_acctbal", "o_totalprice")])
    ranked = raw.select(F.inline(listed)).join(F.broadcast(found), "column").groupBy("column", "rows").agg(
        F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto")
    )
    half, slack = F.col("rows") / 2, F.col("rows") * 0.005 + 1
    return ranked.select("column", "rows", ((F.col("below") <= half + slack) & (F.col("upto") >= half - slack)).alias("in_bound"))


def bucketed_tables(spark, folder, buckets: int = 8):
    """Customers and the totals of their urgent orders, each stored in buckets of the customer key."""
    urgent = (
        table(spark, folder, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("highest"))
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    suffix = uuid.uuid4().hex
    return tuple(store_bucketed(df, f"{name}_{suffix}", "c_custkey", buckets) for name, df in (("customers", customers), ("urgent", urgent)))


@query(
    "entity_join_bucketed",
    """select c_custkey, c_mktsegment, c_acctbal, orders, highest
    from customer left join (
      select o_custkey, count(*)::bigint as orders, max(o_totalprice) as highest from orders
      where o_orderpriority = '1-URGENT' group by o_custkey) on c_custkey = o_custkey""",
)
def entity_join_bucketed(spark, folder):
    """Entities with their totals, both kept in buckets of the key: no row is moved by the join."""
    return join_bucketed(*bucketed_tables(spark, folder), "c_custkey")


@query(
    "entity_table_bucketed",
    """select c_custkey, count(*)::bigint as versions, max(orders) as orders, round(sum(c_acctbal), 6) as balance
    from customer left join (
      select o_custkey, count(*)::bigint as orders from orders where o_orderpriority = '1-URGENT' group by o_custkey)
      on c_custkey = o_custkey group by c_custkey""",
)
def entity_table_bucketed(spark, folder):
    """The joined buckets aggregated by the same key, still without moving a row."""
    joined = join_bucketed(*bucketed_tables(spark, folder), "c_custkey")
    return joined.groupBy("c_custkey").agg(
        F.count(F.lit(1)).alias("versions"), F.max("orders").alias("orders"), F.round(F.sum("c_acctbal"), 6).alias("balance")
    )


@query(
    "sparse_dummies",
    """with cells as (
      select 'p_brand' as "column", p_brand as value, p_partkey from part union all select 'p_name', p_name, p_partkey from part),
    known as (
      select "column", value, row_number() over (partition by "column" order by count(*) desc, value) - 1 as idx
      from cells where p_partkey % 3 <> 0 group by "column", value),
    sizes as (select "column", count(*) as n from known group by "column")
    select c."column", coalesce(k.idx, n)::int as idx, count(*)::double as rows
    from cells c join sizes s on s."column" = c."column" left join known k on k."column" = c."column" and k.value = c.value
    group by c."column", coalesce(k.idx, n)""",
)
def sparse_dummies(spark, folder):
    """Brands and names of all parts as sparse vectors, numbered on two thirds of them; the vectors' sums count each label."""
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name")
    columns = ["p_brand", "p_name"]
    known = vocabulary.label_vocabulary(parts.filter(F.col("p_partkey") % 3 != 0), columns)
    _, vectors = vocabulary.sparse_dummies(parts, columns, known)
    sums = vectors.agg(*[Summarizer.sum(F.col(f"{c}_vec")).alias(c) for c in columns])
    listed = [
        sums.select(F.lit(c).alias("column"), F.posexplode(vector_to_array(c)).alias("idx", "rows")).filter("rows > 0") for c in columns
    ]
    return listed[0].union(listed[1])


@query(
    "csv_quarantine",
    """select 'rows' as kind, o_orderkey, o_custkey, o_orderstatus from (
      select o_orderkey::varchar as o_orderkey, o_custkey::varchar as o_custkey, o_orderstatus from orders where o_orderkey % 11 > 1)
    union all select 'short', o_orderkey::varchar, null, null from orders where o_orderkey % 11 = 0
    union all select 'long', o_orderkey::varchar || ',' || o_custkey || ',' || o_orderstatus || ',x', null, null
      from orders where o_orderkey % 11 = 1
    union all select 'counted', count(*)::varchar, null, null from orders where o_orderkey % 11 < 2""",
)
def csv_quarantine(spark, folder):
    """Orders as CSV with short and long lines among them: good rows, kept broken lines, and their number over all files."""
    source = fresh_path(spark, "broken-csv")
    key = F.col("o_orderkey").cast("string")
    whole = F.concat_ws(",", key, F.col("o_custkey").cast("string"), "o_orderstatus")
    line = F.when(F.col("o_orderkey") % 11 == 0, key).when(F.col("o_orderkey") % 11 == 1, F.concat(whole, F.lit(",x"))).otherwise(whole)
    orders = table(spark, folder, "orders").select(line.alias("o_orderkey,o_custkey,o_orderstatus"))
    # Written as one column without quotes, whose name is the header of three.
    orders.write.option("header", True).option("sep", "\x01").option("quote", "").csv(source)
    expected = T.StructType([T.StructField(c, T.StringType()) for c in ("o_orderkey", "o_custkey", "o_orderstatus")])
    good, bad = tables.scan_csv_checked(spark, source, expected)
    kept = fresh_path(spark, "quarantine")
    counts = tables.quarantine(bad, kept)
    none = F.lit(None).cast("string")
    kind = F.when(F.col("line").endswith(",x"), "long").otherwise("short")
    broken = spark.read.parquet(kept).select(kind.alias("kind"), F.col("line").alias("o_orderkey"), none.alias("o_custkey"), none.alias("o_orderstatus"))
    total = counts.agg(F.sum("lines").cast("string").alias("o_orderkey"))
    total = total.select(F.lit("counted").alias("kind"), "o_orderkey", none.alias("o_custkey"), none.alias("o_orderstatus"))
    return good.select(F.lit("rows").alias("kind"), "*").unionByName(broken).unionByName(total)


@query(
    "published_versions",
    """select 2::bigint as version, n_nationkey, n_name from nation where n_nationkey % 2 = 0""",
)
def published_versions(spark, folder):
    """A table published twice; a third write breaks off, and the second version is still what readers get."""
    path = fresh_path(spark, "published")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    publish(nations.select(F.lit(1).cast("long").alias("version"), "*"), path)
    publish(nations.filter("n_nationkey % 2 = 0").select(F.lit(2).cast("long").alias("version"), "*"), path)
    fails = F.when(F.col("n_nationkey") >= 0, F.raise_error(F.lit("broken off"))).otherwise(3).cast("long")
    try:
        publish(nations.select(fails.alias("version"), "*"), path)
    except Exception as error:
        if "broken off" not in str(error):
            raise
    return read_published(spark, path)
