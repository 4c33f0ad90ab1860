"""WARC archives: written by Spark's text writer, read back in splits by verifying record chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import as_column
from ..sources.staging import fresh_path, stage

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"


def archive_records(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE
) -> DataFrame:
    """One WARC record per page as text in ``record``, without the blank lines that end it.

    Of equal payloads of 1000 bytes or more, the page with the largest id is a ``response``; the others are
    ``revisit`` records that refer to it and leave the payload out. Only digests and ids are grouped,
    so a payload that a third of the pages share costs a row per task. Rows that repeat the largest
    id are responses too; NULL ids come last and are written empty; a NULL payload is empty.
    """
    rows = pages.select(
        as_column(key).alias("id"),
        F.coalesce(F.regexp_replace(as_column(url), r"[\r\n]+", " "), F.lit("")).alias("url"),
        F.coalesce(as_column(payload), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    rows = rows.withColumn("bytes", F.octet_length("payload"))
    groups = rows.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest")
    shared = groups.agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stage(shared.select(F.col("digest").alias("shared_digest"), "original"), "warc-shared")
    known = rows.join(shared, F.col("digest") == F.col("shared_digest"), "left")
    revisit = F.coalesce(~F.col("original").eqNullSafe(F.col("id")) & F.col("original").isNotNull(), F.lit(False))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END),
    )
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    block = F.when(revisit, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("bytes"))
    pieces = [
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        name,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"),
                F.col("original").cast("string"),
                F.lit(">"),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        block.cast("string"),
        F.lit(END),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    ]
    return known.select(F.concat(*pieces).alias("record"))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """One archive per partition. The text writer ends each record with its blank lines and commits whole files."""
    archive_records(pages, **columns).write.option("lineSep", END).text(path)


def _header(name: str) -> Column:
    return F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)


def parsed(segments: DataFrame) -> DataFrame:
    """Adds what the text behind a magic says if it is a record: its headers, ``reach`` (bytes up to its
    successor, NULL if it is no record), and for a text of just that length its payload's digest."""
    cut = F.instr("value", END)
    found = segments.withColumn("head", F.when(cut > 0, F.expr(f"left(value, {_sql(END)} - 1)")))
    found = found.withColumn("length", F.nullif(_header("Content-Length"), F.lit("")).try_cast("long"))
    found = found.withColumn(
        "reach", F.lit(len(MAGIC)) + F.octet_length("head") + 2 * len(END) + F.col("length")
    ).withColumn("whole", F.coalesce(F.col("reach") == F.octet_length("value") + len(MAGIC), F.lit(False)))
    body = F.expr(f"substring(value, {_sql(END)} + {len(END)})")
    found = found.withColumn("body", F.when(F.col("whole"), body))
    body_cut = f"instr(body, '{_escaped(END)}')"
    payload = F.expr(
        f"substring(body, {body_cut} + {len(END)}, char_length(body) - {body_cut} + 1 - {2 * len(END)})"
    )
    found = found.withColumn("payload", F.when(F.col("whole") & F.expr(f"{body_cut} > 0"), payload))
    http = F.expr(f"left(body, {body_cut} - 1)")
    http_length = F.regexp_extract(http, r"(?im)^Content-Length:[ \t]*(\d+)", 1).try_cast("long")
    kept = [c for c in segments.columns if c != "value"]
    return found.select(
        *kept,
        F.octet_length("value").cast("long").alias("size"),
        "reach",
        "whole",
        _header("WARC-Type").alias("record_type"),
        F.regexp_extract(_header("WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("page_id"),
        F.regexp_extract(_header("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
        F.regexp_extract(_header("WARC-Payload-Digest"), r"sha1:(\w+)", 1).alias("stated_digest"),
        http_length.alias("stated_bytes"),
        F.octet_length("payload").cast("long").alias("read_bytes"),
        F.sha1(F.col("payload").cast("binary")).alias("read_digest"),
    )


def _escaped(text: str) -> str:
    return text.replace("\r", "\\r").replace("\n", "\\n")


def _sql(text: str) -> str:
    return f"instr(value, '{_escaped(text)}')"


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The texts between magics, read in splits, in file order by ``file``, ``block`` and ``seq``.

    These three follow from how the files are split, which executors and settings decide anew for every scan. ``h1`` and
    ``h2`` follow from a text alone.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("_metadata.file_size").alias("file_size"),
        F.xxhash64("value").alias("h1"),
        F.xxhash64(F.lit("second key"), "value").alias("h2"),
        "value",
    )


def placed(parts: DataFrame) -> DataFrame:
    """Adds ``at``, the byte in its file at which a segment's magic stands (negative for what precedes the first).

    Block totals are prefix-summed per file, running sums add the place inside a block.
    """
    taken = F.col("size") + len(MAGIC)
    totals = parts.groupBy("file", "block").agg(F.sum(taken).alias("bytes"), F.max("file_size").alias("file_size"))
    by_file = Window.partitionBy("file")
    before = F.sum("bytes").over(by_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(
        "file",
        "block",
        F.coalesce(before, F.lit(0)).alias("block_at"),
        (F.sum("bytes").over(by_file) - len(MAGIC) == F.col("file_size")).alias("covered"),
    )
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("block_at") + F.coalesce(F.sum(taken).over(inside), F.lit(0)) - len(MAGIC)
    checked = F.when(F.col("covered"), at).otherwise(F.raise_error(F.lit("the splits of an archive do not add up")))
    return parts.join(starts, ["file", "block"]).withColumn("at", checked).drop("block_at", "covered")


def reachable_runs(candidates: DataFrame) -> DataFrame:
    """``file``, ``head`` of the runs of records that the chain from byte 0 of their file reaches.

    ``candidates`` holds ``file``, ``head`` and ``next``, the byte at which the run's last record ends. Pointers
    double each round: all runs up to 2^n steps from the start are known after n rounds.
    """
    jumps = stage(candidates, "warc-jumps")
    reached = stage(jumps.filter("head = 0").select("file", "head"), "warc-reached")
    known = reached.count()
    while True:
        step = reached.join(jumps, ["file", "head"]).select("file", F.col("next").alias("head"))
        ends = candidates.select("file", "head")
        reached = stage(reached.union(step.join(ends, ["file", "head"], "left_semi")).distinct(), "warc-reached")
        count = reached.count()
        if count == known:
            return reached
        known = count
        far = jumps.select("file", F.col("head").alias("next"), F.col("next").alias("far"))
        jumps = stage(jumps.join(far, ["file", "next"]).select("file", "head", F.col("far").alias("next")), "warc-jumps")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, one row each.

    Tasks read splits at every magic, whether it begins a record or stands in a payload, and emit the byte at
    which a record there would end. Neighbours that meet form runs; pointer jumping over the runs keeps those
    that the chain from the file's start reaches. A payload that holds magics is put together again from
    its segments. ``intact``: the payload read has the digest that the record states.
    """
    raw = segments(spark, path)
    parts = stage(parsed(raw), "warc-segments")
    found = stage(placed(parts).withColumn("next", F.col("at") + F.col("reach")), "warc-candidates")
    candidates = found.filter((F.col("at") >= 0) & F.col("next").isNotNull())

    in_block = Window.partitionBy("file", "block").orderBy("at")
    chained = candidates.select("file", "block", "at", "next").withColumns(
        {
            "meets": F.coalesce(F.lag("next").over(in_block) == F.col("at"), F.lit(False)),
            "met": F.coalesce(F.lead("at").over(in_block) == F.col("next"), F.lit(False)),
        }
    )
    entries = chained.filter(~F.col("met")).select("file", F.col("next").alias("at"), F.lit(True).alias("entry"))
    begun = chained.join(entries.distinct(), ["file", "at"], "left").withColumn(
        "begins", ~F.col("meets") | F.col("entry").isNotNull()
    )
    head = F.max(F.when(F.col("begins"), F.col("at"))).over(in_block)
    runs = stage(begun.withColumn("head", head).select("file", "at", "next", "head"), "warc-runs")
    heads = runs.groupBy("file", "head").agg(F.max("next").alias("next"))
    good = runs.join(reachable_runs(heads), ["file", "head"], "left_semi").select("file", "at")

    records = stage(found.join(good, ["file", "at"]), "warc-records")
    whole = records.filter("whole")
    torn = spread_records(found, records, raw)
    return whole.select(*RECORD).union(torn.select(*RECORD)).select(
        "page_id",
        F.when(F.col("record_type") == "revisit", F.col("stated_bytes")).otherwise(F.col("read_bytes")).alias(
            "payload_bytes"
        ),
        F.when(F.col("record_type") == "revisit", F.col("stated_digest")).otherwise(F.col("read_digest")).alias(
            "payload_digest"
        ),
        "record_type",
        "refers_to",
        ((F.col("record_type") == "revisit") | (F.col("stated_digest") == F.col("read_digest"))).alias("intact"),
    )


RECORD = "record_type page_id refers_to stated_digest stated_bytes read_bytes read_digest".split()


def spread_records(found: DataFrame, records: DataFrame, raw: DataFrame) -> DataFrame:
    """The records whose payload holds magics, put together from their segments and parsed.

    The files are read again for the texts of these segments only. They are found by their 128-bit keys, not by their
    place, since the second scan may be split in another way. A text that is not found again is an error.
    """
    torn = records.filter("not whole").select("file", "at", "next")
    # The last record begun at or before a segment owns it: known inside a block, else from the blocks before.
    begun = found.join(records.select("file", "at", F.col("at").alias("own")), ["file", "at"], "left")
    lasts = begun.groupBy("file", "block").agg(F.max("own").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("file", "block", F.max("last").over(before).alias("carry"))
    inside = Window.partitionBy("file", "block").orderBy("at")
    owned = begun.join(carried, ["file", "block"]).select(
        "file", "block", "seq", "h1", "h2", F.coalesce(F.max("own").over(inside), "carry").alias("owner")
    )
    wanted = stage(owned.join(torn.select("file", F.col("at").alias("owner")), ["file", "owner"]), "warc-torn")
    found_again = raw.select("h1", "h2", "value").join(wanted.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    values = found_again.groupBy("h1", "h2").agg(F.first("value").alias("value"))
    texts = wanted.join(values, ["h1", "h2"], "left")
    lost = F.raise_error(F.lit("a part of a record was not found again"))
    part = F.struct("block", "seq", F.coalesce("value", lost).alias("value"))
    joined = texts.groupBy("file", "owner").agg(F.sort_array(F.collect_list(part)).alias("p"))
    value = F.array_join(F.transform("p", lambda x: x["value"]), MAGIC)
    return parsed(joined.select("file", "owner", value.alias("value")))


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages as archives (to a new shared folder unless ``path`` is given) and read them back."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)


ORACLE_SQL = """
with sized as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as bytes from pages),
originals as (select *, case when bytes >= 1000 then max(page_id) over (partition by html) end as original from sized)
select page_id, bytes as payload_bytes, sha1(html) as payload_digest,
  case when original <> page_id then 'revisit' else 'response' end as record_type,
  case when original <> page_id then original end as refers_to, true as intact
from originals
"""
