"""Standardised KMeans segments, scored by silhouette under a share rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial
from multiprocessing.pool import ThreadPool

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_column
from ..spec import ShareRule
from .cleaning import fill_missing
from .quantiles import group_medians
from .scoring import sweep_scores

# Tasks of every KMeans iteration and forest level, at least; the command line asks for a number. Larger tables get more.
PARTITIONS = 8
PARTITION_ROWS = 500_000
# Numbers that the fits of a sweep hold at the same time, ten more a row than its features: each fit keeps its own matrices.
HELD = 400_000_000

SWEEP_SCHEMA = "k int, segments int, silhouette double, min_share double, max_share double, accepted boolean"


@dataclass(frozen=True)
class SweepOptions:
    """Numbers of segments to try, the acceptance rule, and how to run the fits.

    ``partitions`` is the least number of partitions of the layout the fits see: with one seed, it alone decides
    the models that the same rows give. At most ``parallelism`` fits run at the same time, fewer over large tables.
    """

    ks: Sequence[int] = tuple(range(2, 21))
    rule: ShareRule = field(default_factory=ShareRule)
    seed: int = 42
    partitions: int = PARTITIONS
    parallelism: int = 8


@dataclass(frozen=True)
class Segmentation:
    predictions: DataFrame
    best_k: int
    silhouette: float
    sweep: DataFrame
    model: KMeansModel
    scaler: PipelineModel


def layout_partitions(df: DataFrame, partitions: int = PARTITIONS) -> int:
    """``partitions``, or one per ``PARTITION_ROWS`` rows if these are more: what a task reads does not grow with the table."""
    return max(partitions, -(-df.count() // PARTITION_ROWS))


def fixed_layout(df: DataFrame, key: str, partitions: int = PARTITIONS) -> DataFrame:
    """The same rows in the same partitions and order, however ``df`` is laid out.

    KMeans and forests draw per partition, so a seed alone does not make them
    reproducible. Rows are spread by all their columns: a key with many versions
    does not end up in one partition. ``df``, which is counted first, should be read from storage.
    """
    columns = [as_column(key), *[as_column(c) for c in df.columns if c != key]]
    return df.repartition(layout_partitions(df, partitions), *columns).sortWithinPartitions(*columns)


def scaling_pipeline(features: Sequence[str]) -> Pipeline:
    """Assemble the features and scale them to mean 0 and sample deviation 1."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="numeric_features", handleInvalid="error")
    scaler = StandardScaler(inputCol="numeric_features", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[assembler, scaler])


def standardize(df: DataFrame, features: Sequence[str]) -> tuple[PipelineModel, DataFrame]:
    model = scaling_pipeline(features).fit(df)
    return model, model.transform(df)


def fit_kmeans(scaled: DataFrame, k: int, seed: int = 42, features: str = "features", solver: str = "block") -> KMeansModel:
    """The model of ``k`` segments. The block solver packs the vectors once into matrices, which it keeps while it iterates;
    the other one decodes the rows of a cached table in every iteration.

    The block solver reads beyond its centres where it starts from fewer than ``k``: among fewer distinct points, or where
    far outliers are all that is drawn. The row solver then gives the model of those centres.
    """
    kmeans = KMeans(k=k, featuresCol=features, seed=seed, solver=solver)
    try:
        return kmeans.fit(scaled)
    except Py4JJavaError as error:
        if solver != "block" or "ArrayIndexOutOfBoundsException" not in str(error):
            raise
    return kmeans.copy().setSolver("row").fit(scaled)


def distinct_points(scaled: DataFrame, most: int, features: str = "features") -> int:
    """How many distinct vectors there are, counted up to ``most``."""
    return scaled.select(features).distinct().limit(most).count()


def silhouette(df: DataFrame, prediction: str = "prediction", features: str = "features") -> float:
    """Mean silhouette with squared Euclidean distances, in two passes over the rows."""
    return ClusteringEvaluator(predictionCol=prediction, featuresCol=features, metricName="silhouette").evaluate(df)


def cluster_shares(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """``(prediction, count, share)``; the total is taken over one row per segment."""
    sizes = df.groupBy(as_column(prediction)).agg(F.count(F.lit(1)).alias("count"))
    total = sizes.agg(F.sum("count").alias("total"))  # one row
    return sizes.join(F.broadcast(total)).withColumn("share", F.col("count") / F.col("total")).drop("total")


def share_rule(shares: DataFrame, rule: ShareRule, silhouette: float | None = None) -> DataFrame:
    """``(min_share, max_share, accepted)`` of a table of segment shares and, if the rule names one, the silhouette."""
    ends = shares.agg(F.min("share").alias("min_share"), F.max("share").alias("max_share"))
    return ends.withColumn("accepted", F.lit(True) & rule.accepts(F.col("min_share"), F.col("max_share"), silhouette))


def assign_all(df: DataFrame, models: Mapping[int, KMeansModel]) -> tuple[DataFrame, dict[int, str]]:
    """Adds each model's segments as a column of its own, in one projection, and names the columns."""
    columns = {k: f"__segment_{k}" for k in models}
    for k, model in models.items():
        df = model.copy().setPredictionCol(columns[k]).transform(df)
    return df, columns


def fits_at_once(scaled: DataFrame, most: int) -> int:
    """How many fits may hold the vectors at the same time. Over a table too large for several, one fit fills the cluster."""
    first = scaled.select("features").first()
    rows = scaled.count()
    return max(1, min(most, HELD // (rows * (len(first[0]) + 10)))) if rows else most


def k_sweep(scaled: DataFrame, options: SweepOptions = SweepOptions()) -> list[dict]:
    """Fit and score every number of segments; one entry each, accepted or not.

    An entry keeps its fitted model (the centres only), so the chosen one needs
    no second fit. ``scaled`` should be cached, since every fit reads it.
    The fits are distributed jobs; a few of them share the cluster at a time, like
    the candidates of a cross validation. All of them are scored together, in two scans.
    Distinct points are counted first: more segments than these have fewer centres, which the row solver fits.
    """

    points = distinct_points(scaled, max(options.ks, default=0))

    def fit(k: int) -> KMeansModel:
        return fit_kmeans(scaled, k, options.seed, solver="block" if k <= points else "row")

    at_once = min(options.parallelism, len(options.ks))
    if at_once > 1:
        at_once = fits_at_once(scaled, at_once)
    if at_once <= 1:
        models = [fit(k) for k in options.ks]
    else:
        with ThreadPool(at_once) as pool:
            # Wrapped one by one: each fit needs its own copy of the thread's job properties.
            fits = [inheritable_thread_target(scaled.sparkSession)(partial(fit, k)) for k in options.ks]
            models = pool.map(lambda run: run(), fits, chunksize=1)
    by_k = dict(zip(options.ks, models))
    scores = sweep_scores(*assign_all(scaled.select("features"), by_k))
    return [
        entry
        | {
            "accepted": entry["silhouette"] is not None
            and bool(options.rule.accepts(entry["min_share"], entry["max_share"], entry["silhouette"])),
            "model": by_k[entry["k"]],
        }
        for entry in scores
    ]


def best_k(sweep: Sequence[dict], rule: ShareRule | None = None) -> dict:
    """The accepted entry with the highest silhouette; the first one wins a tie."""
    accepted = [entry for entry in sweep if entry["accepted"]]
    if not accepted:
        tried = [entry["k"] for entry in sweep]
        raise ValueError(f"no number of segments in {tried} satisfies {rule or 'the share rule'}")
    return max(accepted, key=lambda entry: entry["silhouette"])


def sweep_table(spark, sweep: Sequence[dict]) -> DataFrame:
    names = [part.split()[0] for part in SWEEP_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(entry[n] for n in names) for entry in sweep], SWEEP_SCHEMA)


def segment(
    df: DataFrame, features: Sequence[str], key: str, options: SweepOptions = SweepOptions()
) -> Segmentation:
    """Scale, sweep, take the best accepted number of segments, and assign all rows.

    Missing features count as 0.0; no entity is dropped, and the predictions keep all
    columns of ``df``. ``df`` should be a stored table: the vectors cached
    from it are recomputed if an executor dies.
    """
    filled = fill_missing(df, features)
    needed = filled.select(as_column(key), *[as_column(f) for f in features])
    table = fixed_layout(needed, key, options.partitions).persist(StorageLevel.MEMORY_AND_DISK)
    scaler, scaled = standardize(table, features)
    # The sweep reads nothing but the vectors, so only they stay cached for it.
    vectors = scaled.select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        vectors.count()
        table.unpersist()
        sweep = k_sweep(vectors, options)
        chosen = best_k(sweep, options.rule)
    finally:
        vectors.unpersist()
        table.unpersist()
    return Segmentation(
        # The assignment works row by row and needs neither the layout nor its shuffle.
        predictions=chosen["model"].transform(scaler.transform(filled)),
        best_k=chosen["k"],
        silhouette=chosen["silhouette"],
        sweep=sweep_table(df.sparkSession, sweep),
        model=chosen["model"],
        scaler=scaler,
    )


def cluster_profile(
    predictions: DataFrame,
    features: Sequence[str],
    prediction: str = "prediction",
    digits: int | None = 2,
) -> DataFrame:
    """Exact median of every feature per segment, named ``median_feature``."""
    medians = group_medians(predictions, prediction, features)
    return medians.select(
        as_column(prediction),
        *[(as_column(f) if digits is None else F.round(as_column(f), digits)).alias(f"median_{f}") for f in features],
    )
