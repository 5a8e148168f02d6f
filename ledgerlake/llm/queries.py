"""The registered queries of the operators: key -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import (
    bpe,
    hard_negatives,
    html_main,
    line_dedup,
    line_rules,
    minhash,
    packing,
    quality_classifier,
    secret_ledger,
    spelling,
    substring_dedup,
    topk,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(_table(spark, sf_dir, "pages"))
    out = warc.capture_histories(warc.read_archives(spark, path, with_payload=False))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    ledger = spark.read.schema(secret_ledger.LEDGER).parquet(secret_ledger.update_ledger(docs))
    found = F.col("findings")
    base = [r.kind for r in secret_ledger.BASE]
    of_base = F.filter(found, lambda f: f["kind"].isin(base))
    count = lambda kind: F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_ledger.findings(docs, ledger).select(
        "doc_id", *[count(k) for k in base], F.sha2(secret_ledger.spans_text(of_base), 256).alias("base_sha256"),
        secret_ledger.spans_text(found).alias("spans"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(_table(spark, sf_dir, "documents"), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select(
        "doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_main.extract_main_text(_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_rules.line_first(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset", "bucket")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, moved)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.word_counts(_table(spark, sf_dir, "documents")))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_warc": op2_warc,
        "op3_secret_ledger": op3_secret_ledger,
        "op4_bpe": op4_bpe,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_topk": op6_topk,
        "op7_minhash_dedup": op7_minhash_dedup,
        "op8_html_main_text": op8_html_main_text,
        "op9_line_rules": op9_line_rules,
        "op10_packing": op10_packing,
        "op11_line_dedup": op11_line_dedup,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_spelling_variants": op13_spelling_variants,
    }


def all_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.sql(),
        "op2_warc": warc.sql(),
        "op6_topk": topk.sql(),
        "op7_minhash_dedup": minhash.sql(),
        "op9_line_rules": line_rules.sql(),
        "op11_line_dedup": line_dedup.sql(),
        "op12_hard_negatives": hard_negatives.sql(),
        "op13_spelling_variants": spelling.sql(),
    }
