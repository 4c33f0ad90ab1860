"""WARC round trips and the pipeline."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from segmentry.llm import bpe, decontaminate, lines, near, quality, warc
from segmentry.llm.queries import tokenizer_path
from segmentry.sources.staging import fresh_path
from tests.llm.data import PAGES, documents, odd_texts

MAGIC = warc.MAGIC
FAKE = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "r") for r in rows], PAGES)


ROWS = [
    (1, "u", "a"),
    (2, "u", None),
    (3, None, ""),
    (4, "u", MAGIC),
    (5, "u", MAGIC * 3 + "x" + FAKE + FAKE + "tail"),
    (6, "u", "é" * 600),
    (7, "u", "é" * 600),
    (8, "u", "x" * 999),
    (9, "u", "x" * 999),
    (10, "u\r\nWARC-Type: response", FAKE * 40),
    (11, "u", FAKE * 40),
    (11, "u", FAKE * 40),
    (None, "u", "\r\n\r\n"),
    (12, "u", "\r\n" * 900),
    (13, "u", "WARC/1.1\r"),
    (14, "u", "z" * 5000 + MAGIC + "y" * 5000),
] + [(100 + i, "u", f"k{i} " * (i % 40) + (MAGIC if i % 3 == 0 else "")) for i in range(120)]


def expected(rows):
    top = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            top[html] = max(top.get(html, i), i)
    result = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        again = top.get(html, i) != i
        result[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[html] if again else None, True] += 1
    return result


@pytest.mark.parametrize("split", ["700", "128m"])
def test_round_trip_in_splits_of_any_size(spark, split):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = warc.archived_pages(pages(spark, ROWS).coalesce(3)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert Counter(tuple(r) for r in found) == expected(ROWS)


def in_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.mark.parametrize("sizes", [("128m", "900", "2k"), ("700", "128m", "500")])
def test_splits_may_change_between_the_scans(spark, sizes):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    path = fresh_path(spark, "warc-splits")
    try:
        in_splits(spark, sizes[0])
        warc.write_archives(pages(spark, ROWS).coalesce(2), path)
        in_splits(spark, sizes[1])
        read = warc.read_archives(spark, path)
        in_splits(spark, sizes[2])
        found = read.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert Counter(tuple(r) for r in found) == expected(ROWS)


def test_a_text_that_is_not_found_again_is_an_error(spark, monkeypatch):
    path = fresh_path(spark, "warc-lost")
    warc.write_archives(pages(spark, ROWS), path)
    plain = warc.spread_records
    monkeypatch.setattr(warc, "spread_records", lambda found, records, raw: plain(found, records, raw.filter("h1 % 2 = 0")))
    with pytest.raises(Exception, match="not found again"):
        warc.read_archives(spark, path).collect()


def test_no_pages(spark):
    assert warc.archived_pages(pages(spark, [])).count() == 0


def test_a_record_behind_a_gap_is_not_reached(spark):
    path = fresh_path(spark, "warc-gap")
    good = warc.archive_records(pages(spark, [(1, "u", "first")])).first().record + "\r\n\r\n"
    text = [(good + "stray bytes" + FAKE,)]
    spark.createDataFrame(text, "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    assert [r.page_id for r in warc.read_archives(spark, path).collect()] == [1]


def test_stages_are_the_operators(spark, small):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_dedup", "decontamination", "encoding"
    ]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    columns, before = docs.columns, docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, before, small)
        path = fresh_path(spark, name)
        after.write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == columns and after.dtypes == docs.dtypes
        ids, kept = {r.doc_id for r in before.collect()}, {r.doc_id for r in after.collect()}
        assert kept <= ids and after.count() == len(kept)
        if name == "quality_rules":
            verdict = quality.quality_measures(before)
            assert kept == {r.doc_id for r in verdict.filter("kept").collect()}
        if name == "line_dedup":
            seen = [lines.normal_line(F.col("line")), F.explode(F.split("text", "\n")).alias("line")]
            every = after.select(seen[1]).select(seen[0].alias("n")).filter("n <> ''")
            assert every.count() == every.distinct().count()
        if name == "near_dedup":
            assert kept == {r.doc_id for r in near.near_duplicates(before).filter("kept").collect()}
        if name == "decontamination":
            leaking = {r.doc_id for r in decontaminate.leaks(before, items).collect()}
            assert kept == ids - leaking and not decontaminate.leaks(after, items).count()
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, small)
    assert last.filter("not exact").count() == 0
    wanted = bpe.encode(before, tokenizer_path())
    assert wanted.exceptAll(last.select("doc_id", "ids")).count() == 0
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, small).select("doc_id", "n_tokens").collect()) == Counter(
        tuple(r) for r in last.select("doc_id", "n_tokens").collect()
    )


def test_stages_survive_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "nothing of it")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for source in (odd_texts(), []):
        docs = documents(spark, source)
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, docs, folder)
            assert out.count() <= len(source)
            if name != "encoding":
                assert out.columns == docs.columns
