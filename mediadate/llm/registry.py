"""The registered queries of the operators and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediadate.llm import (
    conversations, decontamination, exact_index, language_model, mixing, quality, ranked_search, repeats, secret_scan, sharding,
    simhash, token_files, warc,
)
from mediadate.llm.oracles import SQL  # noqa: F401


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def source_weights(docs: DataFrame) -> DataFrame:
    """Sources in code point order, null last, weigh 3, 1, 2, 3, 1, 2 and so on.

    Sources are ranked by ranges, with one count per range, so that no task sorts all of them.
    """
    spark = docs.sparkSession
    ranked = sharding.number_rows(
        docs.select("source").distinct().select(
            F.lit(0).alias("shard"), F.col("source").isNull().alias("missing"), "source"
        ),
        ["missing", "source"],
    )
    weight = F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.pmod("slot", F.lit(3)) + 1).cast("int"))
    return ranked.select("source", weight.alias("weight"))


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    mixed = mixing.mix_documents(docs, source_weights(docs), share=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(_table(spark, folder, "documents"), shingle=4, distance=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, folder, "documents"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secret_scan.describe(base), 256).alias("base_sha256"),
        secret_scan.describe(F.concat(base, F.col("linked"))).alias("spans"),
    )


def op4_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    removed = repeats.remove_repeats(_table(spark, folder, "documents"), length=100)
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return removed.select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256",
    )


def op5_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    placed = sharding.shard_documents(docs, shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    scanned = decontamination.scan_documents(docs, _table(spark, folder, "benchmark"))
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), decontamination.contaminated().alias("contaminated"),
    )


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge_documents(_table(spark, folder, "documents"), host="source")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_poor",
    )


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    records = warc.read_whole(warc.write_archives(pages, least_bytes=0))
    kind = pages.schema["page_id"].dataType
    return records.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers").cast(kind).alias("refers_to"),
    )


def op9_language_model(spark: SparkSession, folder: str) -> DataFrame:
    scored = language_model.score_documents(_table(spark, folder, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return encode_table(_table(spark, folder, "documents"))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), 20)


def op12_exact_groups(spark: SparkSession, folder: str) -> DataFrame:
    return exact_index.exact_groups(_table(spark, folder, "documents"))


def op13_repair_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations")
    return conversations.digest_repaired(conversations.repair_conversations(conversations.damage(rows), known=rows))


def encode_table(docs: DataFrame) -> DataFrame:
    """The production parameters: a public vocabulary of 49,408 ids, end id 2."""
    return token_files.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, end_id=2)


QUERIES = {query.__name__: query for query in (
    op1_mix_sources, op2_near_duplicates, op3_secret_scan, op4_repeated_passages, op5_shards, op6_decontaminate, op7_warc, op8_quality,
    op9_language_model, op10_token_files, op11_ranked_search, op12_exact_groups, op13_repair_conversations,
)}
