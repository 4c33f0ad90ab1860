"""The same roles on the retail test tables: customers, and their orders as transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import attach
from ..spec import DatasetSpec, LabelGroups

RETAIL = DatasetSpec(
    entity="c_custkey",
    columns={
        "c_custkey": "customer key",
        "c_mktsegment": "market segment of the customer",
        "c_nationkey": "nation of the customer",
        "c_acctbal": "account balance, stands for the income",
        "o_orderstatus": "status of the order",
        "o_orderpriority": "priority of the order, stands for the risk level",
        "o_totalprice": "amount of the order",
    },
    numeric=["c_acctbal", "o_totalprice"],
    entity_columns=["c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"],
    amount="o_totalprice",
    income="c_acctbal",
    expenses="o_totalprice",
    cash=("o_orderstatus", "f"),
    location="c_nationkey",
    risk_level="o_orderpriority",
    risk_scores={"1-urgent": 3, "2-high": 2},
    dummies={
        "c_mktsegment": ["building", "household", "None"],
        "c_nationkey": ["Other"],
        "o_orderstatus": ["f", "o"],
        "o_orderpriority": ["1-urgent", "None"],
    },
    label_groups=[
        LabelGroups(
            "c_mktsegment", "segment_group", {"Goods": ["furniture", "household"], "Industry": ["machinery"]}
        )
    ],
    keep_labels=["c_custkey", "o_orderpriority"],
    profiled_categories=["c_mktsegment", "o_orderstatus", "o_orderpriority"],
    sentinels=["4-NOT SPECIFIED"],
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with the attributes of its customer repeated on it."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority", "o_totalprice"
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    return attach(orders, customers, "c_custkey", "inner")


def raw_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The transactions as a CSV scan would give them: all text, in spec order."""
    return transactions(spark, folder).select(*[F.col(c).cast("string").alias(c) for c in RETAIL.columns])
