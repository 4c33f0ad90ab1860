import time

import pytest
from pyspark.sql import types as T

from segmentry.sources import staging, tables

SCHEMA = T.StructType([T.StructField(c, T.StringType(), True, {"comment": c.upper()}) for c in ("a", "b")])


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_csv_folder_is_one_all_text_table(spark, tmp_path):
    path = write(tmp_path, one='a,b\n1,"x, y"\n', two="a,b\n2,\n")
    df = tables.scan_csv(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "string"]
    assert {tuple(r) for r in df.collect()} == {("1", "x, y"), ("2", None)}


def test_csv_columns_come_in_the_expected_order(spark, tmp_path):
    df = tables.scan_csv(spark, write(tmp_path, one="b,a\n1,2\n"), SCHEMA)
    assert df.columns == ["a", "b"] and tuple(df.first()) == ("2", "1")
    assert df.schema["a"].metadata["comment"] == "A"


def test_csv_with_other_columns_is_rejected(spark, tmp_path):
    with pytest.raises(ValueError, match=r"missing columns \['b'\], unknown columns \['c'\]"):
        tables.scan_csv(spark, write(tmp_path, one="a,c\n1,2\n"), SCHEMA)


def test_a_file_with_another_header_is_not_read_silently(spark, tmp_path):
    path = write(tmp_path, one="a,b\n1,2\n" * 1, two="b,a\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.scan_csv(spark, path, SCHEMA).collect()


def test_materialize_builds_once_and_again_after_a_broken_write(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert tables.materialize(spark, path, build).count() == 3
    assert tables.materialize(spark, path, build).count() == 3
    assert len(calls) == 1
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert tables.materialize(spark, path, build).count() == 3
    assert len(calls) == 2


def test_write_overwrites(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_parquet(spark.range(5), path)
    assert tables.write_parquet(spark.range(2), path).count() == 2
    assert tables.scan_parquet(spark, path).count() == 2


def test_report_roundtrip(spark, tmp_path):
    report = {"one": spark.range(3), "two": spark.createDataFrame([("a", 1.5)], "k string, v double")}
    tables.save_report(report, str(tmp_path))
    again = tables.load_report(spark, str(tmp_path), ["one", "two"])
    assert again["one"].count() == 3 and tuple(again["two"].first()) == ("a", 1.5)


def test_ranking_roundtrip(spark, tmp_path):
    ranking = spark.createDataFrame([("f", 0.7, 1), ("g", 0.3, 2)], tables.RANKING_SCHEMA)
    tables.save_ranking(ranking, str(tmp_path / "r"))
    assert tables.load_ranking(spark, str(tmp_path / "r")).orderBy("rank").collect() == ranking.collect()


def test_staged_tables_lie_below_the_checkpoint_folder(spark):
    staged = staging.stage(spark.range(4), "x")
    assert staged.count() == 4
    assert staging.checkpoint_dir(spark) in staged.inputFiles()[0] or staged.inputFiles()[0].startswith(
        "file://" + staging.checkpoint_dir(spark)
    )


def test_dropping_staged_tables_deletes_this_applications_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "checkpoint_dir", lambda _: str(tmp_path))
    path = staging.stage(spark.range(4), "x").inputFiles()[0]
    other = tmp_path / "segmentry" / "another-application"
    other.mkdir()
    assert tables.exists(spark, path)
    staging.drop_staged(spark)
    assert not tables.exists(spark, path) and other.exists()


class Named:
    """A session stand-in: only what the folder lookup reads."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):
        return None


def test_the_cluster_names_the_folder():
    assert staging.checkpoint_dir(Named("s3a://shared/cp/", "yarn")) == "s3a://shared/cp"
    unnamed = Named(None, "spark://host:7077")
    unnamed.conf["spark.sql.warehouse.dir"] = "s3a://shared/warehouse"
    assert staging.checkpoint_dir(unnamed) == "s3a://shared/warehouse/staging"


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from segmentry.sources.staging import checkpoint_dir

    def session(master, **settings):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, *default: settings.get(name, *default)))

    warehouse = {"spark.sql.warehouse.dir": "file:/w/"}
    assert checkpoint_dir(session("local[4]", **warehouse)) == "file:/w/staging"
    assert checkpoint_dir(session("yarn", **warehouse, **{"spark.checkpoint.dir": "hdfs:/shared/"})) == "hdfs:/shared"
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_dir(session(master, **warehouse))


def test_tables_staged_on_the_way_are_deleted(spark):
    """``stage_alone`` keeps the result and nothing else, also of nested calls, also if the build fails."""
    met = []

    def inner():
        met.append(staging.fresh_path(spark, "seen"))
        return staging.stage(spark.range(5), "inner")

    def build():
        met.append(staging.fresh_path(spark, "seen"))
        first = staging.stage(spark.range(10), "first")
        return first.join(staging.stage_alone(spark, inner, "second"), "id")

    result = staging.stage_alone(spark, build, "result")
    assert sorted(r.id for r in result.collect()) == list(range(5))
    assert not any(tables.exists(spark, path.rsplit("/", 1)[0]) for path in met)
    with pytest.raises(ZeroDivisionError):
        staging.stage_alone(spark, lambda: 1 / 0, "broken")
    assert staging.fresh_path(spark, "a").rsplit("/", 1)[0] == staging._session_folder(spark)


def test_shuffle_files_go_with_the_staged_table(spark):
    """What a staged write shuffled is of no use once it is written, and must not fill the disks until the driver collects garbage."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in blocks.getAllFiles().mkString("\n").split("\n") if name.endswith(".data")}

    before = shuffled()
    counted = spark.range(10_000).selectExpr("id % 100 as k", "id").groupBy("k").count()
    assert staging.stage(counted, "counted").count() == 100
    assert staging.stage_alone(spark, lambda: counted, "alone").filter("count = 100").count() == 100
    for _ in range(50):
        if len(shuffled() - before) <= 2:
            break
        time.sleep(0.1)
    # The counts above shuffle a single row each, which Spark keeps.
    assert len(shuffled() - before) <= 2
    assert spark.conf.get(staging._SHUFFLE_CLEANUP) == "false"


def test_a_table_staged_meanwhile_is_deleted(spark):
    with staging.staged_meanwhile(spark.range(7), "meanwhile") as table:
        path = table.inputFiles()[0].rsplit("/", 1)[0]
        assert table.count() == 7 and tables.exists(spark, path)
    assert not tables.exists(spark, path)
    with pytest.raises(ZeroDivisionError), staging.staged_meanwhile(spark.range(1), "broken") as table:
        path = table.inputFiles()[0].rsplit("/", 1)[0]
        1 / 0
    assert not tables.exists(spark, path)
