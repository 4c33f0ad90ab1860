"""Queries for scaling, segments, their scores and profiles, and feature ranking.

KMeans and forests have no SQL equivalent. Where the right answer is known
beforehand (the rows form a few distinct points), the SQL states that answer,
in facts that do not depend on how the segments are numbered, or that a check
made in Spark comes out right.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranking, scoring, segmentation
from ..operators.features import feature_names, fitted_dummies, model_features
from ..operators.segmentation import SweepOptions
from ..sources.staging import fresh_path, stage
from ..sources.tables import load_ranking, save_ranking
from ..spec import REGULATOR_RULE, ShareRule
from .catalog_features import retail_features
from .registry import query
from .retail import RETAIL, table


def customer_numbers(spark, folder):
    """Two numeric features per customer."""
    return table(spark, folder, "customer").select(
        "c_custkey", "c_mktsegment", (F.col("c_acctbal") / 1000).alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"),
    )


def customer_features(spark, folder):
    """Stored behaviour features of every customer with orders."""
    return stage(model_features(retail_features(spark, folder), RETAIL), "model-features")


@query(
    "standardize",
    """with f as (select o_custkey as entity, avg(o_totalprice) as a, count(*)::double as n, 3.0::double as c
      from orders group by o_custkey)
    select entity, round((a - avg(a) over ()) / stddev_samp(a) over (), 6) as amount_z,
      round((n - avg(n) over ()) / stddev_samp(n) over (), 6) as orders_z, 0.0::double as constant_z from f""",
)
def standardize(spark, folder):
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("entity"))
    numbers = orders.agg(
        F.avg("o_totalprice").alias("a"), F.count(F.lit(1)).cast("double").alias("n"), F.lit(3.0).alias("c")
    )
    _, scaled = segmentation.standardize(numbers, ["a", "n", "c"])
    z = vector_to_array("features")
    return scaled.select(
        "entity", *[F.round(z[i], 6).alias(f"{name}_z") for i, name in enumerate(["amount", "orders", "constant"])]
    )


def line_points(spark, folder):
    """Lines as 0/1 vectors, one distinct point per return flag and line status, and the same in a fixed layout, cached."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    dummies = fitted_dummies(lines, ["l_returnflag", "l_linestatus"])
    names = [c for c in dummies.columns if c not in lines.columns]
    points = segmentation.standardize(dummies, names)[1]
    needed = points.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "features")
    laid = needed.repartition(segmentation.layout_partitions(lines), "l_orderkey", "l_linenumber")
    return points, laid.sortWithinPartitions("l_orderkey", "l_linenumber").select("features").cache()


KNOWN_SEGMENTS_SQL = """
  select l_returnflag, l_linestatus, count(*)::bigint as rows, 1::bigint as segments
  from lineitem group by l_returnflag, l_linestatus
"""


def known_segments(predictions):
    return predictions.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("prediction").alias("segments")
    )


@query("kmeans_segments", KNOWN_SEGMENTS_SQL)
def kmeans_segments(spark, folder):
    points, vectors = line_points(spark, folder)
    try:
        return known_segments(segmentation.fit_kmeans(vectors, 6).transform(points))
    finally:
        vectors.unpersist()


@query("model_roundtrip", KNOWN_SEGMENTS_SQL)
def model_roundtrip(spark, folder):
    """The same, with the assignment done by the model read back from storage."""
    points, vectors = line_points(spark, folder)
    path = fresh_path(spark, "kmeans")
    try:
        segmentation.fit_kmeans(vectors, 6).write().overwrite().save(path)
    finally:
        vectors.unpersist()
    return known_segments(KMeansModel.load(path).transform(points))


@query(
    "silhouette",
    """with p as (select c_custkey id, c_mktsegment g, c_acctbal / 1000 f0, c_nationkey::double f1 from customer),
    c as (select g, count(*)::double n, sum(f0) y0, sum(f1) y1, sum(f0 * f0 + f1 * f1) psi from p group by g),
    d as (select p.id, p.g pg, c.g cg, c.n, (f0 * f0 + f1 * f1) + psi / n - 2 * (f0 * y0 + f1 * y1) / n dist
      from p cross join c),
    s as (select id, max(case when pg = cg and n > 1 then dist * n / (n - 1) end) a,
      min(case when pg <> cg then dist end) b from d group by id)
    select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from s""",
)
def silhouette(spark, folder):
    points = VectorAssembler(inputCols=["balance", "nation"], outputCol="features").transform(
        customer_numbers(spark, folder)
    )
    _, indexed = ranking.string_index(points, ["c_mktsegment"])
    value = segmentation.silhouette(indexed, "c_mktsegment_idx")
    return spark.createDataFrame([(round(value, 6),)], "silhouette double")


@query(
    "cluster_shares",
    """select c_mktsegment, count(*)::bigint as count, round(count(*)::double / (select count(*) from customer), 6) as share
    from customer group by c_mktsegment""",
)
def cluster_shares(spark, folder):
    shares = segmentation.cluster_shares(table(spark, folder, "customer"), "c_mktsegment")
    return shares.withColumn("share", F.round("share", 6))


def _closed_form(name: str, group: str, features: list[str]) -> str:
    """SQL for the mean silhouette of the groups of customers with the given features, as the table ``name``."""
    f = ", ".join(f"{x} as f{i}" for i, x in enumerate(features))
    square = " + ".join(f"f{i} * f{i}" for i in range(len(features)))
    sums = ", ".join(f"sum(f{i}) as y{i}" for i in range(len(features)))
    dot = " + ".join(f"f{i} * y{i}" for i in range(len(features)))
    return f"""{name}_p as (select c_custkey as id, {group} as g, {f} from customer),
    {name}_c as (select g, count(*)::double as n, {sums}, sum({square}) as psi from {name}_p group by g),
    {name}_d as (select p.id, p.g as pg, c.g as cg, n, ({square}) + psi / n - 2 * ({dot}) / n as dist
      from {name}_p p cross join {name}_c c),
    {name}_s as (select id, max(case when pg = cg and n > 1 then dist * n / (n - 1) end) as a,
      min(case when pg <> cg then dist end) as b from {name}_d group by id),
    {name} as (select avg(case when a is null then 0 else (b - a) / greatest(a, b) end) as silhouette from {name}_s)"""


POINTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "share_rule",
    f"""with {_closed_form("apart", "c_mktsegment", [f"(c_mktsegment = '{p}')::int::double" for p in POINTS])},
    {_closed_form("mixed", "c_mktsegment", ["c_acctbal / 1000", "c_nationkey::double"])},
    s as (select count(*)::double / (select count(*) from customer) as share from customer group by c_mktsegment),
    m as (select min(share) as lo, max(share) as hi from s)
    select 'shares only' as rule, round(lo, 6) as min_share, round(hi, 6) as max_share, null::double as silhouette,
      lo >= 0.01::double and hi <= 0.45::double as accepted from m
    union all select 'regulator, apart', round(lo, 6), round(hi, 6), round(silhouette, 6),
      lo >= 0.05::double and hi <= 0.30::double and silhouette > 0.5::double from m, apart
    union all select 'regulator, mixed', round(lo, 6), round(hi, 6), round(silhouette, 6),
      lo >= 0.05::double and hi <= 0.30::double and silhouette > 0.5::double from m, mixed
    union all select 'too large, apart', round(lo, 6), round(hi, 6), round(silhouette, 6),
      lo >= 0.25::double and hi <= 0.30::double and silhouette > 0.5::double from m, apart""",
)
def share_rule(spark, folder):
    """Market segments as segments: the same shares pass or fail by the silhouette of their features."""
    customers = customer_numbers(spark, folder)
    points = fitted_dummies(customers.select("c_custkey", "c_mktsegment"), ["c_mktsegment"])
    columns = {"apart": [c for c in points.columns if c.startswith("c_mktsegment_")], "mixed": ["balance", "nation"]}
    values = {}
    for name, df in (("apart", points), ("mixed", customers)):
        vectors = VectorAssembler(inputCols=columns[name], outputCol="features").transform(df)
        indexed = ranking.string_index(vectors, ["c_mktsegment"])[1]
        values[name] = segmentation.silhouette(indexed, "c_mktsegment_idx")
    shares = segmentation.cluster_shares(customers, "c_mktsegment")
    cases = [
        ("shares only", ShareRule(), None),
        ("regulator, apart", REGULATOR_RULE, values["apart"]),
        ("regulator, mixed", REGULATOR_RULE, values["mixed"]),
        ("too large, apart", ShareRule(0.25, 0.30, 0.5), values["apart"]),
    ]
    checked = [
        segmentation.share_rule(shares, rule, value).select(
            F.lit(name).alias("rule"),
            F.round("min_share", 6).alias("min_share"),
            F.round("max_share", 6).alias("max_share"),
            F.round(F.lit(value).cast("double"), 6).alias("silhouette"),
            "accepted",
        )
        for name, rule, value in cases
    ]
    return reduce(DataFrame.unionByName, checked)


@query(
    "cluster_profile",
    """select c_mktsegment, round(median(c_acctbal / 1000), 6) as median_balance,
      round(median(c_nationkey::double), 6) as median_nation from customer group by c_mktsegment""",
)
def cluster_profile(spark, folder):
    return segmentation.cluster_profile(customer_numbers(spark, folder), ["balance", "nation"], "c_mktsegment", 6)


@query(
    "cluster_profile_large",
    """select l_linestatus, round(median(l_quantity), 6) as median_l_quantity,
      round(median(l_extendedprice), 6) as median_l_extendedprice,
      round(median(l_discount), 6) as median_l_discount from lineitem group by l_linestatus""",
)
def cluster_profile_large(spark, folder):
    """Two large segments: the middle is bracketed before its values are counted."""
    lines = table(spark, folder, "lineitem")
    measures = ["l_quantity", "l_extendedprice", "l_discount"]
    return segmentation.cluster_profile(lines, measures, "l_linestatus", 6)


@query(
    "string_index",
    """with n as (select c_mktsegment, row_number() over (order by count(*) desc, c_mktsegment) - 1 as idx
      from customer group by c_mktsegment)
    select c_custkey, c.c_mktsegment, idx::double as c_mktsegment_idx from customer c join n using (c_mktsegment)""",
)
def string_index(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return ranking.string_index(customers, ["c_mktsegment"])[1]


@query(
    "segment_entities",
    """select c_mktsegment, count(*)::bigint as entities, 1::bigint as segments, 5::int as best_k,
      1.0::double as silhouette, round(sum(c_acctbal), 2) as kept_balance from customer group by c_mktsegment""",
)
def segment_entities(spark, folder):
    """Customers form one point per market segment: five segments separate them fully."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    dummies = fitted_dummies(customers, ["c_mktsegment"])
    names = [c for c in dummies.columns if c not in customers.columns]
    result = segmentation.segment(
        dummies, names, "c_custkey", SweepOptions(ks=tuple(range(2, 8)), rule=REGULATOR_RULE)
    )
    # The predictions keep the columns that are no features.
    return result.predictions.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("entities"),
        F.countDistinct("prediction").alias("segments"),
        F.lit(result.best_k).alias("best_k"),
        F.lit(round(result.silhouette, 6)).alias("silhouette"),
        F.round(F.sum("c_acctbal"), 2).alias("kept_balance"),
    )


@query(
    "k_sweep_known_points",
    """with s as (select count(*)::double / (select count(*) from customer) as share from customer group by c_mktsegment),
    m as (select min(share) as lo, max(share) as hi from s)
    select k::int as k, 5::int as segments, 1.0::double as silhouette, round(lo, 6) as min_share, round(hi, 6) as max_share,
      lo >= 0.05::double and hi <= 0.30::double as accepted
    from m, (select unnest([5, 6, 7]) as k)""",
)
def k_sweep_known_points(spark, folder):
    """From five segments on, five distinct points are separated fully."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    dummies = fitted_dummies(segmentation.fixed_layout(customers, "c_custkey"), ["c_mktsegment"])
    _, scaled = segmentation.standardize(dummies, [c for c in dummies.columns if c not in customers.columns])
    vectors = scaled.select("features").cache()
    try:
        sweep = segmentation.k_sweep(vectors, SweepOptions(ks=(5, 6, 7), rule=REGULATOR_RULE))
    finally:
        vectors.unpersist()
    rounded = {c: F.round(c, 6) for c in ("silhouette", "min_share", "max_share")}
    return segmentation.sweep_table(spark, sweep).withColumns(rounded)


@query(
    "k_sweep",
    """select k::int as k, true as silhouette_right, true as shares_right, true as accepted_right
    from (select unnest(range(2, 21)) as k)""",
)
def k_sweep(spark, folder):
    """Every number of segments from 2 to 20 on two numeric customer features, each entry checked by its closed form."""
    numbers = customer_numbers(spark, folder).drop("c_mktsegment")
    _, scaled = segmentation.standardize(segmentation.fixed_layout(numbers, "c_custkey"), ["balance", "nation"])
    vectors = scaled.select("features").cache()
    try:
        sweep = segmentation.k_sweep(vectors)
        rows = _sweep_checks(sweep, vectors)
    finally:
        vectors.unpersist()
    return spark.createDataFrame(rows, "k int, silhouette_right boolean, shares_right boolean, accepted_right boolean")


def _sweep_checks(sweep, vectors):
    """Whether silhouette, shares and verdict of each entry follow from sums per segment, as column expressions."""
    z = vector_to_array("features")
    assigned, columns = segmentation.assign_all(vectors, {e["k"]: e["model"] for e in sweep})
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("own")) for k, c in columns.items()])
    points = assigned.select(z[0].alias("x"), z[1].alias("y"), F.inline(listed))
    square = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    sums = points.groupBy("k", "own").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(square).alias("psi")
    )
    mean = [(2 * F.col(s) / F.col("n")).alias(m) for s, m in (("sx", "mx"), ("sy", "my"))]
    sums = stage(sums.select("k", "own", "n", (F.col("psi") / F.col("n")).alias("spread"), *mean), "sums")  # one row per k and segment
    listed = sums.groupBy("k").agg(F.collect_list(F.struct("own", "spread", "mx", "my")).alias("segments"))
    others = F.filter("segments", lambda s: s["own"] != F.col("own")).alias("others")
    known = sums.join(listed, "k").select("k", "own", "n", "spread", "mx", "my", others)

    def beyond(spread, mx, my):
        """How far the mean squared distance to a segment exceeds the row's own square."""
        return spread - F.col("x") * mx - F.col("y") * my

    nearest = F.array_min(F.transform("others", lambda s: beyond(s["spread"], s["mx"], s["my"])))
    own = (square + beyond(F.col("spread"), F.col("mx"), F.col("my"))) * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1))
    placed = points.join(F.broadcast(known), ["k", "own"])
    measured = placed.select("k", "n", own.alias("inside"), (square + nearest).alias("nearest"))
    value = F.when(F.col("n") == 1, 0.0).otherwise(F.try_divide(F.col("nearest") - F.col("inside"), F.greatest("nearest", "inside")))
    means = {r["k"]: r["mean"] for r in measured.groupBy("k").agg(F.avg(value).alias("mean")).collect()}
    sizes = {}
    for r in sums.collect():
        sizes.setdefault(r["k"], []).append(r["n"])
    rows = []
    for e in sweep:
        counts = sizes[e["k"]]
        smallest, largest = min(counts) / sum(counts), max(counts) / sum(counts)
        rows.append(
            (
                e["k"], abs(means[e["k"]] - e["silhouette"]) < 1e-6,
                e["segments"] == len(counts) and (smallest, largest) == (e["min_share"], e["max_share"]),
                e["accepted"] == (smallest >= 0.01 and largest <= 0.45),
            )
        )
    return rows


# Given segments of the customers, by number of segments, as expressions that Spark and SQL read alike.
GIVEN = {2: "c_nationkey % 2", 3: "c_custkey % 3", 5: "c_nationkey div 5", 7: "c_custkey % 7", 25: "c_nationkey"}


@query(
    "sweep_scores",
    "with "
    + ", ".join(
        _closed_form(f"s{k}", g.replace("div", "//"), ["c_acctbal / 1000", "c_nationkey::double"]) for k, g in GIVEN.items()
    )
    + " "
    + " union all ".join(
        f"""select {k} as k, count(*)::int as segments, round(any_value(silhouette), 6) as silhouette,
        round(min(n) / sum(n), 6) as min_share, round(max(n) / sum(n), 6) as max_share from s{k}, s{k}_c"""
        for k in GIVEN
    ),
)
def sweep_scores(spark, folder):
    """All given segmentations scored from two scans."""
    customers = table(spark, folder, "customer").select(
        (F.col("c_acctbal") / 1000).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"),
        *[F.expr(g).alias(f"g{k}") for k, g in GIVEN.items()],
    )
    vectors = VectorAssembler(inputCols=["balance", "nation"], outputCol="features").transform(customers)
    scores = scoring.sweep_scores(vectors, {k: f"g{k}" for k in GIVEN})
    rows = [(s["k"], s["segments"], round(s["silhouette"], 6), round(s["min_share"], 6), round(s["max_share"], 6)) for s in scores]
    return spark.createDataFrame(rows, "k int, segments int, silhouette double, min_share double, max_share double")


def _labelled(spark, folder):
    """Customers labelled by their market segment, which one feature gives away; two others are constant."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    indexed = ranking.string_index(customers, ["c_mktsegment"])[1]
    return indexed.select(
        "c_custkey", F.col("c_mktsegment_idx").alias("cluster"), F.col("c_mktsegment_idx").alias("signal"),
        F.lit(1.0).alias("flat"), F.lit("same").alias("label"),
    )


@query(
    "feature_ranking",
    """select 'signal' as feature, 1.0::double as importance, 1::int as rank
    union all select 'flat', 0.0::double, 2::int union all select 'label', 0.0::double, 3::int""",
)
def feature_ranking(spark, folder):
    """Stored and read back: the feature that is the label explains everything, constants follow in input order."""
    ranked = ranking.rank_features(_labelled(spark, folder), "cluster", ["flat", "signal"], ["label"], "c_custkey")
    path = fresh_path(spark, "ranking")
    save_ranking(ranked.table, path)
    return load_ranking(spark, path).withColumn("importance", F.round("importance", 6))


@query(
    "top_k_features",
    """with p as (select p_brand, avg(p_retailprice) as price, count(*) as n, p_size from part group by p_brand, p_size),
    r as (select 'p' || p_size as feature, sum(n) as total from p group by p_size),
    best as (select feature, row_number() over (order by total desc, feature) as rank from r)
    select feature, case when substr(feature, -1) in ('0', '2', '4', '6', '8') then 'numeric' else 'categorical' end as role
    from best where rank <= 7""",
)
def top_k_features(spark, folder):
    """The most frequent part sizes as a ranking of known importances; even ones count as numeric features."""
    sizes = table(spark, folder, "part").groupBy(F.concat(F.lit("p"), F.col("p_size")).alias("feature"))
    counted = sizes.agg(F.count(F.lit(1)).cast("double").alias("importance")).collect()  # one row per size
    ordered = sorted(counted, key=lambda r: (-r["importance"], r["feature"]))
    rows = [(r["feature"], r["importance"], n) for n, r in enumerate(ordered, start=1)]
    known = spark.createDataFrame(rows, "feature string, importance double, rank int")
    even = [r[0] for r in rows if int(r[0][1:]) % 2 == 0]
    odd = [r[0] for r in rows if int(r[0][1:]) % 2 == 1]
    numeric, categorical = ranking.top_k_features(known, 7, even, odd)
    found = [(f, "numeric") for f in numeric] + [(f, "categorical") for f in categorical]
    return spark.createDataFrame(found, "feature string, role string")


@query(
    "refit_top_k",
    """select c_mktsegment, count(*)::bigint as entities, 1::bigint as segments, 5::bigint as best_k,
      round(sum(c_acctbal), 2) as kept_balance, max((c_mktsegment = 'BUILDING')::int)::double as median_building
    from customer group by c_mktsegment""",
)
def refit_top_k(spark, folder):
    """The best five of six features are one point per market segment; the sixth, noise, is left out."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    dummies = fitted_dummies(customers, ["c_mktsegment"])
    names = [c for c in dummies.columns if c not in customers.columns]
    rows = [(n, 1.0 / (i + 2), i + 1) for i, n in enumerate(names)] + [("c_acctbal", 0.01, len(names) + 1)]
    known = spark.createDataFrame(rows, "feature string, importance double, rank int")
    best, refit = ranking.refit_top_k(
        dummies, known, len(names), ["c_acctbal"], names, "c_custkey",
        SweepOptions(ks=(4, 5, 6), rule=REGULATOR_RULE),
    )
    predictions = stage(refit.predictions.drop("numeric_features", "features"), "refit-predictions")
    profile = segmentation.cluster_profile(predictions, best)
    summed = predictions.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("entities"),
        F.countDistinct("prediction").alias("segments"),
        F.lit(refit.best_k).cast("long").alias("best_k"),
        F.round(F.sum("c_acctbal"), 2).alias("kept_balance"),
        F.min("prediction").alias("prediction"),
    )
    median = F.col("median_c_mktsegment_BUILDING").alias("median_building")
    return summed.join(profile.select("prediction", median), "prediction").drop("prediction")


RANKED_SQL = """select count(distinct o_custkey)::bigint as entities, 7::bigint as features, true as ranks_right
  from orders"""


@query("customer_ranking", RANKED_SQL)
def customer_ranking(spark, folder):
    """Customer features, their segments, the forest's ranking of the features, and the refit on the best seven."""
    numeric, categorical = feature_names(RETAIL)
    features = customer_features(spark, folder)
    options = SweepOptions(ks=tuple(range(2, 9)))
    first = segmentation.segment(features, [*numeric, *categorical], "c_custkey", options)
    labelled = stage(first.predictions.drop("numeric_features", "features"), "predictions")
    labelled = labelled.withColumnRenamed("prediction", "cluster")
    ranked = ranking.rank_features(labelled, "cluster", numeric, categorical, "c_custkey")
    rows = ranked.table.orderBy("rank").collect()  # one row per feature
    falling = all(a["importance"] >= b["importance"] for a, b in zip(rows, rows[1:]))
    right = falling and len(rows) == len(numeric) + len(categorical) and abs(sum(r["importance"] for r in rows) - 1) < 1e-9
    best, refit = ranking.refit_top_k(features, ranked.table, 7, numeric, categorical, "c_custkey", options)
    kept = refit.predictions.filter(F.col("prediction").between(0, refit.best_k - 1))
    return kept.agg(
        F.countDistinct("c_custkey").alias("entities"), F.lit(len(best)).cast("long").alias("features"),
        F.lit(right).alias("ranks_right"),
    )


@query(
    "imposed_ranking",
    """with f as (select o_custkey, avg(o_totalprice) as amount, count(*) as orders from orders group by o_custkey)
    select count(*)::bigint as entities, median(amount) is not null as fitted,
      ['avg_transaction_amount', 'transaction_count'] as leading, true as falling, 1.0::double as total from f""",
)
def imposed_ranking(spark, folder):
    """All customer features, numeric and categorical, under a label imposed by two of them: these must lead the ranking,
    although others (the largest amount, the cash orders) go along with them."""
    numeric, categorical = feature_names(RETAIL)
    features = customer_features(spark, folder)
    imposing = ["avg_transaction_amount", "transaction_count"]
    middle = features.agg(*[F.median(c).alias(c) for c in imposing]).first()
    above = [(F.col(c) > middle[c]).cast("double") for c in imposing]
    labelled = features.withColumn("cluster", 2 * above[0] + above[1])
    rows = ranking.rank_features(labelled, "cluster", numeric, categorical, "c_custkey").table.orderBy("rank").collect()
    values = [r["importance"] for r in rows]  # one row per feature
    return features.agg(
        F.countDistinct("c_custkey").alias("entities"),
        F.lit(middle[imposing[0]] is not None).alias("fitted"),
        F.array(*[F.lit(f) for f in sorted(r["feature"] for r in rows[:2])]).alias("leading"),
        F.lit(values == sorted(values, reverse=True) and len(rows) == len(numeric) + len(categorical)).alias("falling"),
        F.lit(round(sum(values), 9)).alias("total"),
    )
