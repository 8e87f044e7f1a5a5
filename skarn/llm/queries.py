"""The queries of this subpackage: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import decontaminate, lm, mixing, quality, repetition, secrets, simhash, toolcalls, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toolcalls.link(_table(spark, sf_dir, "conversations"))
    return found.select(F.col("conv").alias("conv_id"), "turn", "seq", "role", "kind", "call_id", "status", "problem", "level", "json")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["order"] < len(secrets.BASE))
    count = lambda k: F.size(F.filter(spans, lambda s: s["order"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(secrets.BASE)),
        F.sha2(secrets.digest(base), 256).alias("base_sha256"),
        secrets.digest(spans).alias("spans"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(mixing.sizes(_table(spark, sf_dir, "documents")))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, tree = lm.lm_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("row_id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    hits = F.filter("leaks", lambda x: x["share"] > 0)
    return found.select(
        "doc_id",
        F.transform(hits, lambda x: x["item"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform(hits, lambda x: x["share"])), F.lit(0.0)).alias("share"),
        (F.size(hits) > 0).alias("contaminated"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("quality_score").alias("score"), F.col("quality_keep").alias("kept"))


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.repetition(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    r = F.col("repetition")
    return found.select(
        "doc_id", *(r[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_tool_calls, op2_simhash, op3_secrets, op4_mixing, op5_lm_score, op6_url_filter, op7_warc_zip, op8_decontaminate, op9_quality, op10_repetition,
)}

ORACLES: dict[str, str] = {}
