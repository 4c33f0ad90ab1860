"""The whole flow on the test tables, from CSV files to segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cleaning import missing_columns as lacking_columns
from ..operators.segmentation import SweepOptions, cluster_shares, silhouette
from ..sources.staging import fresh_path
from .catalog_cleaning import CLEANED_SQL
from .flow import run_segmentation
from .registry import query
from .retail import RETAIL, raw_transactions, table


@query(
    "run_segmentation",
    f"""with {CLEANED_SQL}
    select 'orders with other nation' as fact, count(*)::double as value from prepared where c_nationkey = 'Other'
    union all select 'orders without priority', count(*)::double from prepared where o_orderpriority is null
    union all select 'entities', count(distinct c_custkey)::double from prepared
    union all select 'segmented entities', count(distinct c_custkey)::double from prepared
    union all select 'sum of amounts', round(sum(o_totalprice), 2) from prepared
    union all select 'sweep entries', 38.0::double
    union all select 'wrong verdicts', 0.0::double
    union all select 'sweeps with another best', 0.0::double
    union all select 'scores apart from the evaluator', 0.0::double
    union all select 'shares apart from the sweep', 0.0::double
    union all select 'entities in conflict', 0.0::double""",
)
def flow(spark, folder):
    """The flow from CSV files written from the tables, as it is used: both sweeps over k = 2..20 under the default
    rule, which rejects some, the ranking and the refit on the best seven. The facts do not depend on how segments are
    numbered; those about sweeps compare them with the stored predictions they led to."""
    source, output = fresh_path(spark, "flow-csv"), fresh_path(spark, "flow")
    raw_transactions(spark, folder).write.option("header", True).csv(source)
    options = SweepOptions()
    result = run_segmentation(spark, source, output, RETAIL, options, sample_rows=100)
    sweeps = [[r.asDict() for r in t.collect()] for t in (result.first_sweep, result.sweep)]  # one row per k
    verdicts = [
        e["accepted"] == (options.rule.min_share <= e["min_share"] and e["max_share"] <= options.rule.max_share)
        for sweep in sweeps
        for e in sweep
    ]
    best = [max((e for e in sweep if e["accepted"]), key=lambda e: (e["silhouette"], -e["k"])) for sweep in sweeps]
    predictions = [result.first_predictions, result.predictions]
    found = [[r["share"] for r in cluster_shares(p).collect()] for p in predictions]  # one row per segment
    scores = [silhouette(p) for p in predictions]
    checks = {
        "sweep entries": len(verdicts),
        "wrong verdicts": verdicts.count(False),
        "sweeps with another best": sum(len(shares) != e["segments"] for shares, e in zip(found, best)),
        "scores apart from the evaluator": sum(abs(s - e["silhouette"]) > 1e-6 for s, e in zip(scores, best)),
        "shares apart from the sweep": sum(
            (min(shares), max(shares)) != (e["min_share"], e["max_share"]) for shares, e in zip(found, best)
        ),
    }
    facts = {
        "orders with other nation": result.cleaned.agg(F.count_if(F.col("c_nationkey") == "Other")),
        "orders without priority": result.cleaned.agg(F.count_if(F.col("o_orderpriority").isNull())),
        "entities": result.features.agg(F.count(F.lit(1))),
        "segmented entities": result.predictions.agg(F.countDistinct("c_custkey")),
        "sum of amounts": result.cleaned.agg(F.round(F.sum("o_totalprice"), 2)),
        **{fact: spark.createDataFrame([(float(value),)], "n double") for fact, value in checks.items()},
        "entities in conflict": result.report["entity_conflicts"].agg(F.count(F.lit(1))),
    }
    parts = [df.toDF("value").select(F.lit(fact).alias("fact"), F.col("value").cast("double")) for fact, df in facts.items()]
    listed = parts[0]
    for part in parts[1:]:
        listed = listed.union(part)
    return listed


@query(
    "missing_columns",
    """select unnest(['numeric', 'categorical', 'categorical']) as role, unnest(['c_income', 'c_job', 'c_town']) as missing
    where exists (select 1 from customer)""",
)
def missing_columns(spark, folder):
    """Required columns that the customers lack, by role."""
    customers = table(spark, folder, "customer")
    lacking = lacking_columns(customers, ["c_acctbal", "c_income"], ["c_mktsegment", "c_town", "c_job"])
    rows = [(role, name) for role, names in lacking.items() for name in names]
    return spark.createDataFrame(rows, "role string, missing string")
