import pytest
from pyspark.sql import functions as F

from segmentry.operators import cleaning
from segmentry.operators.cleaning import RareLabels
from segmentry.plans.bank import BANK
from segmentry.spec import DatasetSpec


def one_column(spark, values, name="c", kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def values(df, name="c"):
    return [r[name] for r in df.collect()]


def test_sentinel_is_matched_on_trimmed_text_before_lowering(spark):
    df = one_column(spark, ["None", " None ", "none", None, " Bogota D.C.  "])
    assert values(cleaning.text_normalize(df, ["c"], ["None"])) == [None, None, "none", None, "bogota d.c."]


def test_trim_removes_blanks_only(spark):
    assert values(cleaning.text_normalize(one_column(spark, [" \tA\t "]), ["c"])) == ["\ta\t"]


def test_numbers_that_are_none_become_null(spark):
    df = one_column(spark, ["1.5", " 2 ", "abc", "", None, "None", "NaN", "1e3"])
    assert values(cleaning.numeric_cast(df, ["c"], ["None"])) == [1.5, 2.0, None, None, None, None, None, 1000.0]


def test_fill_missing_covers_null_nan_and_text(spark):
    df = one_column(spark, [1.0, None, float("nan")], kind="double")
    assert values(cleaning.fill_missing(df, ["c"])) == [1.0, 0.0, 0.0]
    assert values(cleaning.fill_missing(one_column(spark, ["x", "3"]), ["c"])) == [0.0, 3.0]


def test_rare_label_below_the_threshold_is_replaced_and_the_exact_threshold_kept(spark):
    below = one_column(spark, ["a"] * 20 + ["b"])  # 1 of 21
    assert set(values(cleaning.rare_label_collapse(below, ["c"]))) == {"a", "Other"}
    exact = one_column(spark, ["a"] * 19 + ["b"])  # 1 of 20
    assert set(values(cleaning.rare_label_collapse(exact, ["c"]))) == {"a", "b"}


def test_null_counts_in_the_total_and_stays_null(spark):
    # 2 of 41 is rare only because the 3 NULL rows count in the total
    df = one_column(spark, ["a"] * 36 + ["b"] * 2 + [None] * 3)
    out = values(cleaning.rare_label_collapse(df, ["c"]))
    assert out.count("Other") == 2 and out.count(None) == 3 and out.count("a") == 36


def test_a_column_of_only_rare_labels_keeps_none_of_them(spark):
    df = one_column(spark, [f"v{i}" for i in range(50)] + [None])
    assert set(values(cleaning.rare_label_collapse(df, ["c"]))) == {"Other", None}


def test_label_named_like_another_column_is_kept_apart(spark):
    df = spark.createDataFrame([("x", "y")] * 30 + [("y", "x")], "a string, b string")
    out = cleaning.rare_label_collapse(df, ["a", "b"]).distinct().collect()
    assert {tuple(r) for r in out} == {("x", "y"), ("Other", "Other")}


def test_fitted_labels_survive_storage_and_apply_to_other_rows(spark):
    fitted = RareLabels.fit(spark.createDataFrame([("a", "z")] * 10, "c string, d string").withColumn(
        "d", F.monotonically_increasing_id().cast("string")), ["c", "d"], 0.5)
    again = RareLabels.from_table(fitted.to_table(spark))
    assert again == RareLabels({"c": ("a",), "d": ()})
    unseen = spark.createDataFrame([("new", None), ("a", "q")], "c string, d string")
    assert [tuple(r) for r in again.transform(unseen).collect()] == [("Other", None), ("a", "Other")]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_shares_do_not_depend_on_the_layout(spark, small, parts):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(parts)
    shares = cleaning.label_shares(docs, ["source", "lang"]).collect()
    for column in ("source", "lang"):
        assert sum(r["share"] for r in shares if r["column"] == column) == pytest.approx(1.0)


def test_label_counts_are_scanned_once(spark, small):
    """The totals reuse the shuffled counts instead of reading the table again."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    shares = cleaning.label_shares(docs, ["source", "lang"])
    shares.collect()
    plan = shares._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("FileScan") == 1


def test_names_are_normalised(spark):
    assert cleaning.normalize_names(["A b", "c.d,", "x/y-z", "P & Q"]) == ["a_b", "cd", "x_y_z", "p_and_q"]


def test_colliding_names_are_an_error():
    with pytest.raises(ValueError, match="collide"):
        cleaning.normalize_names(["a b", "a_b"])


def test_missing_columns_are_listed_by_role(spark):
    df = spark.range(1)
    assert cleaning.missing_columns(df, ["id", "n"], ["c", "b"]) == {"numeric": ["n"], "categorical": ["b", "c"]}
    with pytest.raises(ValueError, match="missing"):
        cleaning.require_columns(df, ["n"], [])
    cleaning.require_columns(df, ["id"], [])


def test_numeric_columns_are_never_collapsed():
    assert "score_riesgo_mun" not in BANK.collapsed
    assert not set(BANK.collapsed) & {"cli", "profn", "ocup", "nivel_riesgo_ciiu", *BANK.numeric}
    assert len(BANK.collapsed) == 16


def test_a_column_has_one_role():
    with pytest.raises(ValueError, match="numeric and categorical"):
        BANK.with_(profiled_categories=["ing_mes"])
    with pytest.raises(ValueError, match="unknown"):
        BANK.with_(location="nowhere")
    with pytest.raises(ValueError, match="entity key"):
        BANK.with_(entity_columns=["mun_res"])
    assert isinstance(BANK, DatasetSpec)


def test_descriptions_travel_with_the_cleaned_columns(spark):
    raw = spark.createDataFrame([tuple(["None"] * len(BANK.columns))], BANK.raw_schema())
    cleaned = cleaning.clean_columns(raw, BANK)
    assert cleaned.schema["trn_monto"].metadata["comment"] == "transaction amount"
    assert cleaned.schema["trn_monto"].dataType.simpleString() == "double"
    assert all(v is None for v in cleaned.first())


def test_bounded_fit_keeps_the_same_labels(spark):
    n = 20_000
    label = lambda salt, top: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(top)).cast("string")
    df = spark.range(0, n, 1, 5).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"),
        F.when(F.col("id") % 20 == 0, "edge").when(F.col("id") % 20 < 9, label(1, 5000)).alias("mixed"),
        label(2, 21).alias("even"),
        F.lit(None).cast("string").alias("nothing"),
        F.when(F.col("id") < n * 0.05 - 1, "below").otherwise(label(3, 9000)).alias("just_below"),
    )
    columns = df.columns
    exact, bounded = RareLabels.fit(df, columns), RareLabels.fit_bounded(df, columns)
    assert exact.kept == bounded.kept and exact.kept["mixed"] == ("edge",) and exact.kept["key"] == ()
    candidates, rows = cleaning.frequent_candidates(df, columns, 0.05)
    assert rows == n and max(map(len, candidates.values())) <= 40
    assert cleaning.candidate_counts(df, candidates).count() <= sum(map(len, candidates.values()))
    assert RareLabels.fit_bounded(df.limit(0), columns).kept == RareLabels.fit(df.limit(0), columns).kept
