"""The whole way from raw CSV files to profiled segments.

Every step stores its table below the output folder, with a manifest of what it
was made from, and is skipped when that table is complete and the manifest still
holds. So a broken run continues where it stopped, and a changed one starts there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import RareLabels, clean_columns, fit_labels, normalize_names
from ..operators.features import build_features, feature_names, model_features
from ..operators.locations import profile_sample
from ..operators.profiling import observed_quality, report_sections
from ..operators.ranking import rank_features, top_k_features
from ..operators.segmentation import Segmentation, SweepOptions, cluster_profile, cluster_shares, segment
from ..sources.tables import is_complete, load_ranking, manifest, materialize, scan_csv, source_manifest, store
from ..spec import DatasetSpec

TOP_FEATURES = 7
SAMPLE_ROWS = 10_000


@dataclass(frozen=True)
class FlowResult:
    cleaned: DataFrame
    report: dict[str, DataFrame]
    features: DataFrame
    first_predictions: DataFrame
    first_sweep: DataFrame
    ranking: DataFrame
    top_features: list[str]
    predictions: DataFrame
    sweep: DataFrame
    shares: DataFrame
    profile: DataFrame
    sample: DataFrame
    model: KMeansModel


def clean_transactions(
    spark: SparkSession, source: str, output: str, spec: DatasetSpec
) -> tuple[DataFrame, str]:
    """The cleaned transactions and their manifest.

    The raw text is parsed once and stored typed; the frequent labels are stored too.
    The collapse itself is a cheap projection that every reader of the stored
    table applies to the columns it needs, so it is not written a second time.
    """
    written_for = manifest("typed", source_manifest(spark, source), spec)
    if not is_complete(spark, f"{output}/typed", written_for):
        rows, sections = observed_quality(clean_columns(scan_csv(spark, source, spec.raw_schema()), spec), spec)
        store(rows, f"{output}/typed", written_for)
        # Data quality was gathered on the way; these sections of the report need no scan of their own.
        for name, table in sections(2).items():
            store(table, f"{output}/report/{name}", manifest(name, manifest("labels", written_for)))
    typed = spark.read.parquet(f"{output}/typed")
    kept = materialize(
        spark, f"{output}/labels", lambda: fit_labels(typed, spec).to_table(spark), manifest("labels", written_for)
    )
    return RareLabels.from_table(kept, spec.other_label).transform(typed), manifest("labels", written_for)


def report_transactions(
    spark: SparkSession, cleaned: DataFrame, output: str, spec: DatasetSpec, upstream: str
) -> dict[str, DataFrame]:
    """The profiling report; sections already stored are not computed again."""
    return {
        name: materialize(spark, f"{output}/report/{name}", build, manifest(name, upstream))
        for name, build in report_sections(cleaned, spec).items()
    }


def entity_features(
    spark: SparkSession, cleaned: DataFrame, output: str, spec: DatasetSpec, upstream: str
) -> DataFrame:
    return materialize(
        spark, f"{output}/features", lambda: build_features(cleaned, spec), manifest("features", upstream)
    )


def store_segmentation(
    spark: SparkSession, table: DataFrame, features, key: str, options: SweepOptions, path: str, written_for: str
) -> tuple[DataFrame, DataFrame, KMeansModel]:
    """Predictions, sweep and model stored under ``path``, computed only if missing or made for another manifest.

    The predictions are written last: their presence means all three are there.
    """
    if not is_complete(spark, f"{path}/predictions", written_for):
        result: Segmentation = segment(table, features, key, options)
        result.model.write().overwrite().save(f"{path}/model")
        result.scaler.write().overwrite().save(f"{path}/scaler")
        result.sweep.write.mode("overwrite").parquet(f"{path}/sweep")
        store(result.predictions, f"{path}/predictions", written_for)
    return (
        spark.read.parquet(f"{path}/predictions"),
        spark.read.parquet(f"{path}/sweep"),
        KMeansModel.load(f"{path}/model"),
    )


def store_ranking(
    spark: SparkSession,
    predictions: DataFrame,
    numeric,
    categorical,
    key: str,
    options: SweepOptions,
    output: str,
    written_for: str,
) -> tuple[RandomForestClassificationModel, DataFrame]:
    """Forest and feature ranking of the first segmentation, computed only if missing."""
    if not is_complete(spark, f"{output}/ranking", written_for):
        labelled = predictions.withColumnRenamed("prediction", "cluster").drop("numeric_features", "features")
        ranked = rank_features(
            labelled, "cluster", numeric, categorical, key, seed=options.seed, partitions=options.partitions
        )
        ranked.model.write().overwrite().save(f"{output}/forest")
        store(ranked.table, f"{output}/ranking", written_for)
    return RandomForestClassificationModel.load(f"{output}/forest"), load_ranking(spark, f"{output}/ranking")


def run_segmentation(
    spark: SparkSession,
    source: str,
    output: str,
    spec: DatasetSpec,
    options: SweepOptions = SweepOptions(),
    top_k: int = TOP_FEATURES,
    sample_rows: int = SAMPLE_ROWS,
) -> FlowResult:
    """Clean, profile, build features, segment, rank features, segment again, profile.

    A step is taken from ``output`` only if it was made from the same source files, spec, options and steps before it.
    """
    cleaned, clean_id = clean_transactions(spark, source, output, spec)
    report = report_transactions(spark, cleaned, output, spec, clean_id)
    features = entity_features(spark, cleaned, output, spec, clean_id)

    numeric, categorical = feature_names(spec)
    table_id = manifest("model_features", clean_id)
    table = materialize(spark, f"{output}/model_features", lambda: model_features(features, spec), table_id)
    key = normalize_names([spec.entity])[0]
    fitted = (tuple(options.ks), options.rule, options.seed, options.partitions)
    first_id = manifest("first", table_id, *fitted)
    first, first_sweep, _ = store_segmentation(
        spark, table, [*numeric, *categorical], key, options, f"{output}/first", first_id
    )
    ranking_id = manifest("ranking", first_id)
    _, ranking = store_ranking(spark, first, numeric, categorical, key, options, output, ranking_id)
    best_numeric, best_categorical = top_k_features(ranking, top_k, numeric, categorical)
    best = [*best_numeric, *best_categorical]
    final_id = manifest("final", ranking_id, best)
    predictions, sweep, model = store_segmentation(spark, table, best, key, options, f"{output}/final", final_id)

    listed = predictions.drop("numeric_features", "features")

    def last(name: str, build, *settings) -> DataFrame:
        return materialize(spark, f"{output}/{name}", build, manifest(name, final_id, *settings))

    return FlowResult(
        cleaned=cleaned,
        report=report,
        features=features,
        first_predictions=first,
        first_sweep=first_sweep,
        ranking=ranking.orderBy(F.desc("importance"), "rank"),
        top_features=best,
        predictions=predictions,
        sweep=sweep,
        shares=last("shares", lambda: cluster_shares(predictions)),
        profile=last("profile", lambda: cluster_profile(predictions, best)),
        sample=last("sample", lambda: profile_sample(listed, sample_rows, listed.columns), sample_rows),
        model=model,
    )
