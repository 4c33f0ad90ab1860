"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import bpe, classifier, decontaminate, dialogs, lines, mixing, near, quality, ranked, secrets, sharding, tokens, warc
from .registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES", "tokenizer_path"]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the vocabulary lies: SEGMENTRY_TOKENIZERS names its folder, else the installed package does."""
    folder = os.environ.get("SEGMENTRY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_sharding")
def op2_sharding(spark, sf_dir):
    return sharding.balanced_shards(table(spark, sf_dir, "documents"))


@query("op7_quality_rules", quality.ORACLE_SQL)
def op7_quality_rules(spark, sf_dir):
    return quality.quality_measures(table(spark, sf_dir, "documents")).drop("cleaned")


@query("op10_bpe")
def op10_bpe(spark, sf_dir):
    coded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_minhash")
def op8_minhash(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents")).drop("raw")


@query("op5_line_dedup")
def op5_line_dedup(spark, sf_dir):
    docs = lines.numbered(table(spark, sf_dir, "documents"), "doc_id", "text")
    return lines.line_decisions(docs, lines.EDIT_RULES).select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed"
    )


@query("op4_decontamination")
def op4_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_warc", warc.ORACLE_SQL)
def op6_warc(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


@query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    return tokens.document_token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op9_quality_classifier")
def op9_quality_classifier(spark, sf_dir):
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_lm_scoring")
def op1_lm_scoring(spark, sf_dir):
    return mixing.lm_scores(table(spark, sf_dir, "documents"))


@query("op11_lexical_search", ranked.ORACLE_SQL)
def op11_lexical_search(spark, sf_dir):
    return ranked.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_conversation_repair", dialogs.ORACLE_SQL)
def op12_conversation_repair(spark, sf_dir):
    return dialogs.repaired_conversations(table(spark, sf_dir, "conversations"))


@query("op13_secret_scan")
def op13_secret_scan(spark, sf_dir):
    return secrets.secret_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))
