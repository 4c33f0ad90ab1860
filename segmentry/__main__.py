"""``python -m segmentry SOURCE OUTPUT``: the whole flow for bank transaction files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.segmentation import SweepOptions
from .plans.bank import BANK
from .plans.flow import SAMPLE_ROWS, TOP_FEATURES, run_segmentation
from .sources.staging import drop_staged
from .spec import ShareRule


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="segmentry", description=__doc__)
    parser.add_argument("source", help="folder of CSV files with a header")
    parser.add_argument("output", help="folder for all tables and models; a broken run continues there")
    parser.add_argument("--max-segments", type=int, default=20)
    parser.add_argument("--min-share", type=float, default=0.01)
    parser.add_argument("--max-share", type=float, default=0.45)
    parser.add_argument("--min-silhouette", type=float)
    parser.add_argument("--top-features", type=int, default=TOP_FEATURES)
    parser.add_argument("--sample-rows", type=int, default=SAMPLE_ROWS)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--parallel-fits", type=int, default=8)
    parser.add_argument(
        "--partitions", type=int, required=True,
        help="tasks of every fit, at least the cores of the cluster and about one per million entities; with the seed, it decides the models",
    )
    chosen = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("segmentry").getOrCreate()
    options = SweepOptions(
        ks=tuple(range(2, chosen.max_segments + 1)),
        rule=ShareRule(chosen.min_share, chosen.max_share, chosen.min_silhouette),
        seed=chosen.seed,
        partitions=chosen.partitions,
        parallelism=chosen.parallel_fits,
    )
    try:
        result = run_segmentation(
            spark, chosen.source, chosen.output, BANK, options, chosen.top_features, chosen.sample_rows
        )
    finally:
        drop_staged(spark)
    result.ranking.show(len(result.top_features), truncate=False)
    result.sweep.orderBy("k").show(len(options.ks))
    result.shares.orderBy("prediction").show()
    result.profile.orderBy("prediction").show(truncate=False)


if __name__ == "__main__":
    main()
