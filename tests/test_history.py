"""Incremental runs, merged sketches, bucketed tables and wide correlations."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from segmentry.operators import cleaning, entities, profiling, sketches
from segmentry.plans import incremental
from segmentry.plans.incremental import History
from segmentry.plans.retail import RETAIL
from segmentry.sources.buckets import join_bucketed, store_bucketed
from tests.oracle import normal_rows


def lines(seed, n):
    state = random.Random(seed)
    rows = []
    for _ in range(n):
        c = state.randint(1, 12)
        rows.append(
            [str(c), state.choice(["BUILDING", "machinery ", "RARE%d" % c]), str(c % 5), str(c * 10.0), state.choice("FOP"),
             state.choice(["1-URGENT", "2-HIGH", "4-NOT SPECIFIED"]), state.choice([str(state.randint(1, 99)), "n/a", "0"])]
        )
    return rows


def write_file(folder, name, rows):
    text = "\n".join(",".join(r) for r in [list(RETAIL.columns), *rows])
    (folder / name).write_text(text + "\n", encoding="utf-8")


def same(a, b):
    b = b.select(*a.columns)
    return normal_rows(a.columns, a.collect()) == normal_rows(b.columns, b.collect())


def full_run(spark, source):
    raw = spark.read.option("header", True).csv(str(source))
    return entities.entity_table(cleaning.preprocess(raw, RETAIL), RETAIL)


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in", History(None, str(tmp_path / "state"), RETAIL)


def test_batches_equal_one_full_run_and_old_files_are_not_opened(spark, folders, monkeypatch):
    source, history = folders
    history = History(spark, history.state, RETAIL)
    opened, plain = [], incremental.scan_csv
    monkeypatch.setattr(incremental, "scan_csv", lambda s, paths, *a: opened.append(sorted(p.split("/")[-1] for p in paths)) or plain(s, paths, *a))
    for batch, names in enumerate((["a.csv", "b.csv"], ["c.csv"], ["d.csv"])):
        for name in names:
            write_file(source, name, lines(name, 40 + 200 * batch))
        assert history.take_in(str(source)) == len(names)
        assert history.take_in(str(source)) == 0
        # A label that was frequent in the first batch may be rare over all of them, and the other way round.
        assert same(history.entities(), full_run(spark, source))
    assert opened == [["a.csv", "b.csv"], ["c.csv"], ["d.csv"]]
    amounts = [float(r[6]) for n, k in zip("abcd", (40, 40, 240, 440)) for r in lines(f"{n}.csv", k) if r[6] != "n/a"]
    found = {r["column"]: r for r in history.quantiles().collect()}
    assert found["o_totalprice"]["rows"] == len(amounts)
    assert abs(found["o_totalprice"]["value"] - sorted(amounts)[len(amounts) // 2]) <= 1


def test_a_run_that_breaks_off_is_taken_in_once(spark, folders, monkeypatch):
    source, history = folders
    history = History(spark, history.state, RETAIL)
    write_file(source, "a.csv", lines(1, 60))
    plain = incremental.quantile_sketches
    monkeypatch.setattr(incremental, "quantile_sketches", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        history.take_in(str(source))
    assert history.ledger().count() == 0
    with pytest.raises(ValueError, match="nothing"):
        history.entities()
    monkeypatch.setattr(incremental, "quantile_sketches", plain)
    write_file(source, "b.csv", lines(2, 60))
    assert history.take_in(str(source)) == 2
    assert same(history.entities(), full_run(spark, source))


def test_changed_files_and_other_data_sets_are_errors(spark, folders):
    source, history = folders
    history = History(spark, history.state, RETAIL)
    write_file(source, "a.csv", lines(1, 30))
    history.take_in(str(source))
    with pytest.raises(ValueError, match="a.csv"):
        History(spark, history.state, RETAIL.with_(rare_share=0.2)).take_in(str(source))
    write_file(source, "a.csv", lines(1, 31))
    with pytest.raises(ValueError, match="a.csv"):
        history.take_in(str(source))


def test_merged_sketches_keep_their_error_and_skip_missing_cells(spark):
    state = random.Random(1)
    values = [state.gauss(0, 1) ** 3 for _ in range(40_000)]
    rows = [(g, v) for g in ("a", None) for v in values[:: 1 if g else 3]] + [("a", None), ("a", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    parts = [sketches.quantile_sketches(df.filter(F.pmod(F.hash("v"), F.lit(5)) == i), ["v"], "g") for i in range(5)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    found = sketches.sketch_quantiles(sketches.merge_sketches(merged), [0.01, 0.5, 0.99]).collect()
    assert {r["group"] for r in found} == {"a", None}
    for r in found:
        ordered = np.sort(values[:: 1 if r["group"] else 3])
        assert r["rows"] == len(ordered)
        assert abs(np.searchsorted(ordered, r["value"]) / len(ordered) - r["rank"]) < sketches.RANK_ERROR


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_joins_and_aggregates_move_no_rows(spark):
    left = spark.range(500).select(F.when(F.col("id") % 9 > 0, F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 100, 2).select(F.col("id").alias("k"), (F.col("id") * 3).alias("w"))
    a, b = store_bucketed(left, "left_rows", "k", 4), store_bucketed(right, "right_rows", "k", 4)
    joined = join_bucketed(a, b, "k")
    grouped = joined.groupBy("k").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    for df in (joined, grouped):
        assert "Exchange" not in plan_of(df) and "SortMergeJoin" in plan_of(df)
    assert "Exchange" in plan_of(left.join(right.hint("merge"), "k"))
    assert same(joined, left.join(right, "k", "left"))
    assert grouped.count() == 101
    for name in ("left_rows", "right_rows"):
        spark.sql(f"drop table {name}")


def wide(spark, rows=300, width=19):
    state = random.Random(3)
    data = [[None if state.random() < 0.2 else state.gauss(j, 1 + j) for j in range(width)] for _ in range(rows)]
    for i, row in enumerate(data):
        row[3] = 7.0  # constant
        row[4] = None  # never present
        row[5] = row[0] if i % 2 else None
        row[6] = None if row[5] is not None else row[6]  # no row in common with the one before
        row[7] = 5.0 if row[8] is not None else float(i)  # constant wherever the next one is present
        row[9] = 1e9 + (row[1] or 0.0)
    return spark.createDataFrame(data, ", ".join(f"`c.{j}` double" for j in range(width))), data


def test_wide_correlations_equal_pairwise_complete_ones(spark):
    df, data = wide(spark)
    frame = pd.DataFrame(data, columns=df.columns, dtype=float)
    found = {r["column"]: r for r in profiling.correlation_matrix(df, df.columns).collect()}
    assert list(found) == df.columns
    for a in df.columns:
        for b in df.columns:
            both = frame[[a, b]].dropna() if a != b else frame[[a, a]].dropna()
            x, y = both.iloc[:, 0], both.iloc[:, 1]
            if len(both) == 0 or x.min() == x.max() or y.min() == y.max():
                assert found[a][b] is None, (a, b)
            else:
                assert found[a][b] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6), (a, b)


def test_wide_correlations_of_no_rows(spark):
    df, _ = wide(spark)
    rows = profiling.correlation_matrix(df.limit(0), df.columns).collect()
    assert len(rows) == len(df.columns) and all(v is None for r in rows for v in r[1:])


def test_the_correlation_plan_grows_with_the_columns_not_with_their_pairs(spark):
    def size(width):
        df = spark.createDataFrame([[1.0] * width], ", ".join(f"c{j} double" for j in range(width)))
        sums = profiling.pair_sums(df.toDF(*[f"x{j}" for j in range(width)]), width)
        return plan_of(sums).count("sum(") , len(plan_of(profiling.correlation_matrix(df, df.columns)))

    (few, short), (many, long) = size(15), size(60)
    assert few == many and long < 5 * short
