"""Queries for scans, sinks, cleaning and projections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cleaning
from ..sources import tables
from ..sources.staging import fresh_path
from .registry import ORACLES, query
from .retail import RETAIL, raw_transactions, table

# One row per order, cleaned like a raw file: the common start of several oracles.
CLEANED_SQL = """
cleaned as (
  select c_custkey::varchar as c_custkey, lower(trim(c_mktsegment)) as c_mktsegment,
    c_nationkey::varchar as c_nationkey, c_acctbal,
    lower(trim(o_orderstatus)) as o_orderstatus,
    lower(nullif(trim(o_orderpriority), '4-NOT SPECIFIED')) as o_orderpriority, o_totalprice
  from orders join customer on c_custkey = o_custkey),
shares as (
  select 'c_mktsegment' as col, c_mktsegment as label, count(*)::double / (select count(*) from cleaned) as share
  from cleaned group by c_mktsegment
  union all
  select 'c_nationkey', c_nationkey, count(*)::double / (select count(*) from cleaned)
  from cleaned group by c_nationkey
  union all
  select 'o_orderstatus', o_orderstatus, count(*)::double / (select count(*) from cleaned)
  from cleaned group by o_orderstatus),
prepared as (
  select c_custkey,
    case when c_mktsegment in (select label from shares where col = 'c_mktsegment' and share < 0.05::double)
      then 'Other' else c_mktsegment end as c_mktsegment,
    case when c_nationkey in (select label from shares where col = 'c_nationkey' and share < 0.05::double)
      then 'Other' else c_nationkey end as c_nationkey,
    c_acctbal,
    case when o_orderstatus in (select label from shares where col = 'o_orderstatus' and share < 0.05::double)
      then 'Other' else o_orderstatus end as o_orderstatus,
    o_orderpriority, o_totalprice
  from cleaned)
"""


@query(
    "scan_csv",
    """select o_orderkey::varchar as o_orderkey, o_custkey::varchar as o_custkey, o_orderstatus, o_orderpriority
    from orders""",
)
def scan_csv(spark, folder):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    path = fresh_path(spark, "orders-csv")
    table(spark, folder, "orders").select(*columns).write.option("header", True).csv(path)
    expected = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return tables.scan_csv(spark, path, expected)


@query("parquet_roundtrip", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def parquet_roundtrip(spark, folder):
    path = fresh_path(spark, "customer")
    tables.write_parquet(table(spark, folder, "customer"), path)
    return tables.scan_parquet(spark, path)


@query("materialize", "select l_returnflag, count(*)::bigint as rows from lineitem group by l_returnflag")
def materialize(spark, folder):
    path = fresh_path(spark, "line-counts")

    def build():
        return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"))

    tables.materialize(spark, path, build)
    return tables.materialize(spark, path, build)


@query(
    "sentinel_to_null",
    """select o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') as o_orderpriority, o_orderstatus from orders""",
)
def sentinel_to_null(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return cleaning.sentinel_to_null(orders, ["4-NOT SPECIFIED"], ["o_orderpriority", "o_orderstatus"])


@query(
    "numeric_cast",
    """select o_orderkey, case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice,
      case when o_orderkey % 7 = 0 then 0.0::double else o_totalprice end as filled
    from orders""",
)
def numeric_cast(spark, folder):
    text = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    raw = table(spark, folder, "orders").select("o_orderkey", text.alias("o_totalprice"), text.alias("filled"))
    return cleaning.fill_missing(cleaning.numeric_cast(raw, ["o_totalprice"]), ["filled"])


@query("text_normalize", "select p_partkey, lower(trim(p_name)) as p_name, lower(p_type) as p_type from part")
def text_normalize(spark, folder):
    part = table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("p_name"), "p_type"
    )
    return cleaning.text_normalize(part, ["p_name", "p_type"])


@query(
    "label_shares",
    """select 'source' as "column", source as value, count(*)::bigint as rows,
      round(count(*)::double / (select count(*) from documents), 6) as share from documents group by source
    union all
    select 'lang', lang, count(*)::bigint, round(count(*)::double / (select count(*) from documents), 6)
    from documents group by lang""",
)
def label_shares(spark, folder):
    shares = cleaning.label_shares(table(spark, folder, "documents"), ["source", "lang"])
    return shares.withColumn("share", F.round("share", 6))


@query(
    "rare_label_collapse",
    """with s as (
      select role, count(*)::double / (select count(*) from conversations) as share from conversations group by role)
    select c.conv_id, c.turn, case when s.share < 0.05::double then 'Other' else c.role end as role
    from conversations c join s on c.role = s.role""",
)
def rare_label_collapse(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return cleaning.rare_label_collapse(turns, ["role"])


@query(
    "rare_label_collapse_wide",
    """with s as (
      select 'p_brand' as col, p_brand as label, count(*)::double / (select count(*) from part) as share
      from part group by p_brand
      union all
      select 'p_type', p_type, count(*)::double / (select count(*) from part) from part group by p_type
      union all
      select 'p_name', p_name, count(*)::double / (select count(*) from part) from part group by p_name)
    select p_partkey,
      case when p_brand in (select label from s where col = 'p_brand' and share < 0.05::double)
        then 'Other' else p_brand end as p_brand,
      case when p_type in (select label from s where col = 'p_type' and share < 0.05::double)
        then 'Other' else p_type end as p_type,
      case when p_name in (select label from s where col = 'p_name' and share < 0.05::double)
        then 'Other' else p_name end as p_name
    from part""",
)
def rare_label_collapse_wide(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    return cleaning.rare_label_collapse(part, ["p_brand", "p_type", "p_name"])


@query("rare_labels_bounded", ORACLES["rare_label_collapse_wide"])
def rare_labels_bounded(spark, folder):
    """The same, without shuffling the labels of a column that is nearly a key."""
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    return cleaning.RareLabels.fit_bounded(part, ["p_brand", "p_type", "p_name"]).transform(part)


@query("preprocess", f"with {CLEANED_SQL} select * from prepared")
def preprocess(spark, folder):
    return cleaning.preprocess(raw_transactions(spark, folder), RETAIL)


@query(
    "fill_missing",
    """select c_custkey, coalesce(max(o_totalprice), 0.0::double) as highest,
      coalesce(round(avg(o_totalprice), 6), 0.0::double) as average
    from customer left join (select * from orders where o_orderpriority = '1-URGENT') on c_custkey = o_custkey
    group by c_custkey""",
)
def fill_missing(spark, folder):
    from ..operators.entities import entity_join

    urgent = (
        table(spark, folder, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.max("o_totalprice").alias("highest"), F.round(F.avg("o_totalprice"), 6).alias("average"))
    )
    customers = table(spark, folder, "customer").select("c_custkey")
    return cleaning.fill_missing(entity_join(customers, urgent, "c_custkey"), ["highest", "average"])


@query(
    "normalize_columns",
    """select c_custkey as customer_no, c_name as full_name_text, c_acctbal as balance_and_credit,
      c_mktsegment as market_segment from customer""",
)
def normalize_columns(spark, folder):
    awkward = (
        table(spark, folder, "customer")
        .select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
        .toDF("Customer No.", "Full-Name/Text", "Balance & Credit", "Market, Segment")
    )
    return cleaning.normalize_columns(awkward)


@query("project_drop", "select c_custkey as entity, c_acctbal, c_mktsegment from customer")
def project_drop(spark, folder):
    customers = table(spark, folder, "customer")
    return customers.drop("c_name", "c_nationkey").withColumnRenamed("c_custkey", "entity")


@query(
    "predicates",
    """select o_orderkey,
      case when o_orderstatus = 'F' then 1 else 0 end as is_final,
      case when priority is null or priority like '%LOW%' then 1 else 0 end as is_low_or_missing,
      case when priority in ('1-URGENT', '2-HIGH') then 1 else 0 end as is_pressing,
      case when o_totalprice < 100000 then 'small' when o_totalprice < 300000 then 'medium' else 'large' end as size
    from (select *, nullif(o_orderpriority, '4-NOT SPECIFIED') as priority from orders)
    where o_totalprice < 450000""",
)
def predicates(spark, folder):
    orders = table(spark, folder, "orders").filter(F.col("o_totalprice") < 450000)
    orders = cleaning.sentinel_to_null(
        orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"),
        ["4-NOT SPECIFIED"],
        ["o_orderpriority"],
    )
    status, priority, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    return orders.select(
        "o_orderkey",
        F.when(status == "F", 1).otherwise(0).alias("is_final"),
        F.when(priority.isNull() | priority.contains("LOW"), 1).otherwise(0).alias("is_low_or_missing"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("is_pressing"),
        F.when(price < 100000, "small").when(price < 300000, "medium").otherwise("large").alias("size"),
    )
