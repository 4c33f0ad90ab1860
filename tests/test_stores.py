"""Vocabularies of any size, malformed files, and results that are replaced whole or not at all."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmentry.operators.vocabulary import index_labels, label_vocabulary, sparse_dummies
from segmentry.sources import tables
from segmentry.sources.publish import current_version, publish, read_published


def test_a_hundred_thousand_labels_are_numbered_by_frequency(spark):
    many = 100_000
    label = F.when(F.col("id") < many, F.concat(F.lit("l"), F.col("id").cast("string"))).otherwise("hot")
    df = spark.range(0, many + 40_000, 1, 7).select("id", label.alias("c"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("d"))
    known = label_vocabulary(df, ["c", "d"])
    rows = known.filter("column = 'c'").orderBy("idx")
    assert [r.idx for r in rows.select("idx").collect()] == [float(i) for i in range(many + 1)]
    first = rows.limit(3).collect()
    assert [(r.value, r.rows) for r in first] == [("hot", 40_000), ("l0", 1), ("l1", 1)]
    _, vectors = sparse_dummies(df, ["c", "d"], known)
    found = vectors.filter("id in (0, 5, 100001)").orderBy("id").collect()
    assert all(r.c_vec.size == many + 2 and r.c_vec.numNonzeros() == 1 for r in found)
    assert [int(r.c_vec.indices[0]) for r in found][2] == 0
    assert [r.d_vec.toArray().tolist() for r in found] == [[0.0, 1.0], [1.0, 0.0], [1.0, 0.0]]


def test_unknown_labels_and_unknown_columns_get_the_last_number(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "`x y` string")
    known = label_vocabulary(df, ["x y"])
    other = spark.createDataFrame([("b", 1), ("z", 2), (None, 3)], "`x y` string, n int")
    assert [r["x y_idx"] for r in index_labels(other, ["x y"], known).orderBy("n").collect()] == [0.0, 2.0, 2.0]
    nothing = label_vocabulary(df.limit(0), ["x y"])
    _, vectors = sparse_dummies(other, ["x y"], nothing)
    assert [r[0] for r in vectors.select(vector_to_array("x y_vec")).collect()] == [[1.0]] * 3


EXPECTED = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])


def test_malformed_lines_are_kept_and_counted_per_file(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.csv").write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n,,\n")
    (source / "two.csv").write_text('a,b,c\n"x,y",2,\n\n7\n')
    good, bad = tables.scan_csv_checked(spark, str(source), EXPECTED)
    assert sorted(tuple(r) for r in good.fillna("").collect()) == [("", "", ""), ("1", "2", "3"), ("x,y", "2", "")]
    counts = tables.quarantine(bad, str(tmp_path / "bad"))
    assert {r.file.split("/")[-1]: r.lines for r in counts.collect()} == {"one.csv": 2, "two.csv": 1}
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["4,5", "6,7,8,9", "7"]
    (source / "three.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception):
        tables.scan_csv_checked(spark, str(source / "three.csv"), EXPECTED)


def test_a_broken_write_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(ValueError):
        read_published(spark, path)
    publish(spark.range(3), path)
    before = read_published(spark, path)
    publish(spark.range(5), path)
    assert before.count() == 3 and read_published(spark, path).count() == 5
    version = current_version(spark, path)
    with pytest.raises(Exception, match="lost"):
        publish(spark.range(9).select(F.when(F.col("id") > 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id")), path)
    assert current_version(spark, path) == version and read_published(spark, path).count() == 5
    publish(spark.range(7), path)
    folders = sorted(p.name for p in (tmp_path / "table" / "versions").iterdir() if not p.name.startswith("."))
    assert len(folders) == 2 and folders[0] == version
    assert read_published(spark, path).count() == 7
