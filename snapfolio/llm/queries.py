"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapfolio.llm import (
    clustering,
    decontaminate,
    fill_middle,
    langid,
    licenses,
    line_dedup,
    minhash,
    packing,
    quality_rank,
    quality_rules,
    suffix_tree,
    token_counts,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scored(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark's passages, with items and spans."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text as it is left, its lines and how many went."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), wide=True)
    return out.select(
        "doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed")
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    return read.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    base = quality_rules.apply_policy(entries, 1, "base_kept")
    judged = quality_rules.apply_policy(base, 2)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), "kept",
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: directories by source, language and thousand of the id."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws(
        "/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string")
    )
    files = docs.select("doc_id", path.alias("path"), "text")
    return licenses.license_scan(files, keep=("doc_id",))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"))


def op10_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rank.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(_table(spark, sf_dir, "embeddings"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and places of the cuts, digests of what was written and of what is restored from it."""
    out = fill_middle.transformed(_table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


#: Tokens beyond which a document is over the limit.
TOKEN_LIMIT = 1024


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_counts(_table(spark, sf_dir, "documents"))
    return counts.select(
        "doc_id", "n_bytes", token_counts.total(F.col("counts")).alias("n_tokens"),
        token_counts.over_budget(F.col("counts"), TOKEN_LIMIT).alias("over_limit"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_suffix_tree, op2_best_fit_packing, op3_decontaminate, op4_line_dedup, op5_warc,
            op6_quality_rules, op7_minhash, op8_licenses, op9_language, op10_quality_rank,
            op11_clustering, op12_fill_middle, op13_token_counts,
        )
    }
