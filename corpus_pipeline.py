"""The corpus pipeline: documents in, a cleaned and mixed training set out.

Every stage takes all that its predecessor kept, as Parquet, and but for the last returns the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.core.durable import discard, shared_path
from skarn.llm import decontaminate, mixing, neardup, quality, secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.classify(docs).where("quality_keep").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    return neardup.keep_one(docs).select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.exists("leaks", lambda x: x["share"] > 0)).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with how many: whole epochs and the part at the cut."""
    mixed = mixing.mix(docs)
    return mixed.where("mix_taken > 0").select(*COLUMNS, F.col("mix_size").alias("size"), F.col("mix_taken").alias("taken"))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("secret scans", secrets_stage),
    ("source mixing", mix_stage),
]

#: The classifier and the latent space are fitted, which SQL can't express; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; a stage's folder goes once its successor's is complete."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                discard(spark, before)
            before = path
    return docs
