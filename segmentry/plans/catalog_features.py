"""Queries for entities, joins, dummies and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, entities, features
from ..spec import LabelGroups
from .catalog_cleaning import CLEANED_SQL
from .registry import query
from .retail import RETAIL, raw_transactions, table, transactions

EVENT_TYPES = ["click", "error", "None"]

# Grouped labels of part types; all others are "Others".
TYPE_GROUPS = LabelGroups(
    "p_type", "type_group", {"Cheap": ["ECONOMY", "PROMO"], "Regular": ["STANDARD", "SMALL", "MEDIUM"]}
)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


BEHAVIOR_SQL = """
  select c_custkey, round(avg(o_totalprice), 6) as avg_transaction_amount,
    count(o_totalprice)::bigint as transaction_count,
    count(*) filter (lower(o_orderstatus) = 'f')::bigint as cash_transactions,
    max(c_acctbal) as monthly_income, max(o_totalprice) as monthly_expenses,
    round(max(c_acctbal) / nullif(max(o_totalprice), 0), 6) as income_expense_ratio
  from orders join customer on c_custkey = o_custkey group by c_custkey
"""


@query("entity_behavior", BEHAVIOR_SQL)
def entity_behavior(spark, folder):
    spec = RETAIL.with_(cash=("o_orderstatus", "F"))
    behavior = entities.entity_behavior(transactions(spark, folder), spec)
    return rounded(behavior, "avg_transaction_amount", "income_expense_ratio")


@query("distinct_entities", "select distinct o_custkey, o_orderstatus from orders")
def distinct_entities(spark, folder):
    return entities.distinct_entities(table(spark, folder, "orders"), ["o_custkey", "o_orderstatus"])


@query(
    "entity_conflicts",
    """select o_custkey, count(distinct o_orderstatus)::bigint as versions from orders
    group by o_custkey having count(distinct o_orderstatus) > 1""",
)
def entity_conflicts(spark, folder):
    return entities.entity_conflicts(table(spark, folder, "orders"), "o_custkey", ["o_custkey", "o_orderstatus"])


@query(
    "entity_join",
    """select c_custkey, c_mktsegment, c_acctbal, orders, highest
    from customer left join (
      select o_custkey, count(*)::bigint as orders, max(o_totalprice) as highest from orders
      where o_orderpriority = '1-URGENT' group by o_custkey) on c_custkey = o_custkey""",
)
def entity_join(spark, folder):
    urgent = (
        table(spark, folder, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("highest"))
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return entities.entity_join(customers, urgent, "c_custkey")


ENTITY_TABLE_SQL = f"""
  select v.c_custkey, v.c_mktsegment, v.c_nationkey, v.c_acctbal, avg_transaction_amount, transaction_count,
    cash_transactions, monthly_income, monthly_expenses, income_expense_ratio
  from (select distinct c_custkey, c_mktsegment, c_nationkey, c_acctbal from customer
    where c_custkey in (select o_custkey from orders)) v
  left join ({BEHAVIOR_SQL}) b on v.c_custkey = b.c_custkey
"""


@query("entity_table", ENTITY_TABLE_SQL)
def entity_table(spark, folder):
    spec = RETAIL.with_(cash=("o_orderstatus", "F"), dummies={})
    entity = entities.entity_table(transactions(spark, folder), spec)
    return rounded(entity, "avg_transaction_amount", "income_expense_ratio")


@query(
    "entity_medians",
    """select user_id, median(case when event_type = 'click' then 1 else 0 end)::double as event_type_click_median,
      median(case when event_type = 'error' then 1 else 0 end)::double as event_type_error_median,
      median(case when event_type is null then 1 else 0 end)::double as "event_type_None_median"
    from (select user_id, nullif(event_type, 'view') as event_type from events) group by user_id""",
)
def entity_medians(spark, folder):
    spec = RETAIL.with_(
        entity="user_id",
        columns={"user_id": "user", "event_type": "event", "value": "amount"},
        numeric=["value"],
        entity_columns=["user_id"],
        amount="value",
        income="value",
        expenses="value",
        cash=("event_type", "click"),
        location="event_type",
        risk_level="event_type",
        dummies={"event_type": EVENT_TYPES},
        label_groups=(),
        keep_labels=(),
        profiled_categories=(),
    )
    events = table(spark, folder, "events").select("user_id", "event_type")
    return entities.entity_medians(cleaning.sentinel_to_null(events, ["view"], ["event_type"]), spec)


@query(
    "fixed_dummies",
    """select c_custkey, case when c_mktsegment = 'BUILDING' then 1 else 0 end as "c_mktsegment_BUILDING",
      case when c_mktsegment = 'HOUSEHOLD' then 1 else 0 end as "c_mktsegment_HOUSEHOLD",
      case when c_mktsegment = 'MACHINERY' then 1 else 0 end as "c_mktsegment_None"
    from customer""",
)
def fixed_dummies(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    customers = cleaning.sentinel_to_null(customers, ["MACHINERY"], ["c_mktsegment"])
    return features.fixed_dummies(customers, {"c_mktsegment": ["BUILDING", "HOUSEHOLD", "None"]}).drop("c_mktsegment")


@query(
    "label_grouping",
    """select p_partkey, p_type, case when p_type in ('ECONOMY', 'PROMO') then 'Cheap'
      when p_type in ('STANDARD', 'SMALL', 'MEDIUM') then 'Regular' else 'Others' end as type_group from part""",
)
def label_grouping(spark, folder):
    return features.label_grouping(table(spark, folder, "part").select("p_partkey", "p_type"), TYPE_GROUPS)


@query(
    "fitted_dummies",
    "select event_id, "
    + ", ".join(
        f"""case when event_type = '{e}' then 1 else 0 end as event_type_{e}"""
        for e in ("click", "error", "purchase", "signup", "view")
    )
    + " from events",
)
def fitted_dummies(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    return features.fitted_dummies(events, ["event_type"]).drop("event_type")


FEATURES_SQL = f"""
with {CLEANED_SQL},
versions as (select distinct c_custkey, c_mktsegment, c_nationkey, c_acctbal from prepared),
behavior as (
  select c_custkey, round(avg(o_totalprice), 6) as avg_transaction_amount,
    count(o_totalprice)::bigint as transaction_count,
    count(*) filter (o_orderstatus = 'f')::bigint as cash_transactions,
    max(c_acctbal) as monthly_income, max(o_totalprice) as monthly_expenses,
    round(max(c_acctbal) / nullif(max(o_totalprice), 0), 6) as income_expense_ratio
  from prepared group by c_custkey),
medians as (
  select c_custkey, median(case when o_orderstatus = 'f' then 1 else 0 end)::double as status_f,
    median(case when o_orderstatus = 'o' then 1 else 0 end)::double as status_o,
    median(case when o_orderpriority = '1-urgent' then 1 else 0 end)::double as urgent,
    median(case when o_orderpriority is null then 1 else 0 end)::double as unspecified
  from prepared group by c_custkey),
features as (
  select v.c_custkey, v.c_acctbal, avg_transaction_amount, transaction_count, cash_transactions, monthly_income,
    monthly_expenses, income_expense_ratio,
    case when c_mktsegment = 'building' then 1 else 0 end as "c_mktsegment_building",
    case when c_mktsegment = 'household' then 1 else 0 end as "c_mktsegment_household",
    case when c_mktsegment is null then 1 else 0 end as "c_mktsegment_None",
    case when c_nationkey = 'Other' then 1 else 0 end as "c_nationkey_Other",
    case when c_mktsegment in ('furniture', 'household') then 1 else 0 end as "segment_group_Goods",
    case when c_mktsegment = 'machinery' then 1 else 0 end as "segment_group_Industry",
    case when c_mktsegment in ('furniture', 'household', 'machinery') then 0 else 1 end as "segment_group_Others",
    status_f as "o_orderstatus_f_median", status_o as "o_orderstatus_o_median",
    urgent as "o_orderpriority_1-urgent_median", unspecified as "o_orderpriority_None_median"
  from versions v left join behavior b on v.c_custkey = b.c_custkey left join medians m on v.c_custkey = m.c_custkey)
"""


def retail_features(spark, folder):
    return features.build_features(cleaning.preprocess(raw_transactions(spark, folder), RETAIL), RETAIL)


@query("entity_features", f"{FEATURES_SQL} select * from features")
def entity_features(spark, folder):
    return rounded(retail_features(spark, folder), "avg_transaction_amount", "income_expense_ratio")


@query(
    "model_features",
    f"""{FEATURES_SQL} select c_custkey, c_acctbal, avg_transaction_amount, transaction_count::double as transaction_count,
      cash_transactions::double as cash_transactions, monthly_income, monthly_expenses,
      coalesce(income_expense_ratio, 0) as income_expense_ratio,
      "c_mktsegment_building"::double as c_mktsegment_building, "c_mktsegment_household"::double as c_mktsegment_household,
      "c_mktsegment_None"::double as c_mktsegment_none, "c_nationkey_Other"::double as c_nationkey_other,
      "segment_group_Goods"::double as segment_group_goods, "segment_group_Industry"::double as segment_group_industry,
      "segment_group_Others"::double as segment_group_others, "o_orderstatus_f_median" as o_orderstatus_f_median,
      "o_orderstatus_o_median" as o_orderstatus_o_median, "o_orderpriority_1-urgent_median" as o_orderpriority_1_urgent_median,
      "o_orderpriority_None_median" as o_orderpriority_none_median
    from features""",
)
def model_features(spark, folder):
    table_ = features.model_features(retail_features(spark, folder), RETAIL)
    return rounded(table_, "avg_transaction_amount", "income_expense_ratio")
