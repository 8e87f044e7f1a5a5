"""Structured Streaming forms of the listeners: duplicate guard, throttle, incremental statistics.

State is bounded by watermarks, where the batch forms keep growing sets.  Every function takes
and returns a streaming DataFrame, or names the sink that it starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skarn.core.durable import shared_path
from skarn.functions import text as X
from skarn.operators import corpus

HEAD = 500  # a message is known by so much of it; the head is the feature
LEAST = 30


def folder(spark: SparkSession, path: str, schema: str, form: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """New files of a folder; a changed file must come under a new name."""
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", per_trigger).load(path)


def text_of(envelope: str = "value") -> Column:
    """The text of a JSON envelope: raw, text or body, else the message itself."""
    parts = [F.get_json_object(envelope, f"$.{k}") for k in ("raw", "text", "body")]
    return F.coalesce(*parts, F.col(envelope))


def heard(messages: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    return messages.where(F.length(X.strip(F.col(text_col))) >= least)


def unseen(messages: DataFrame, ts: str, text_col: str = "text", memory: str = "1 hour", normalise: bool = False) -> DataFrame:
    """Messages whose head was not seen within ``memory``; state is dropped behind the watermark."""
    head = F.substring(text_col, 1, HEAD)
    digest = X.content_hash(X.normalised(head) if normalise else head)
    return messages.withColumn("digest", digest).withWatermark(ts, memory).dropDuplicatesWithinWatermark(["digest"]).drop("digest")


def throttled(messages: DataFrame, ts: str, sender: str, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """One message per sender and tumbling window."""
    windowed = messages.withWatermark(ts, late).withColumn("slot", F.window(ts, every).start)
    return windowed.dropDuplicatesWithinWatermark([sender, "slot"]).drop("slot")


def fan_out(messages: DataFrame, members: DataFrame) -> DataFrame:
    """Each message once per member; ``members`` is a small table of configurations."""
    return messages.crossJoin(F.broadcast(members))


def windowed_counts(messages: DataFrame, ts: str, key: str, every: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    window = F.window(ts, every, slide) if slide else F.window(ts, every)
    return messages.withWatermark(ts, late).groupBy(window, key).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", key, "n")


def eat(messages: DataFrame, table: str, id_col: str, text_col: str, trigger: dict | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Appends term counts of each micro-batch under ``table/batch=N``: a batch that is replayed overwrites itself.

    Sums over batches equal the batch statistics, so a vocabulary can be refitted at any time.
    """

    def fold(batch: DataFrame, number: int) -> None:
        stats = corpus.token_stats(corpus.token_lists(batch, id_col, text_col))
        stats.write.mode("overwrite").parquet(f"{table}/batch={number}")

    at = checkpoint or shared_path(messages.sparkSession, "stream")
    return messages.writeStream.foreachBatch(fold).option("checkpointLocation", at).trigger(**(trigger or {"availableNow": True})).start()


def eaten(spark: SparkSession, table: str) -> DataFrame:
    """Term statistics of all batches; ids must not repeat across batches."""
    parts = spark.read.parquet(table)
    return parts.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"), F.max("last_id").alias("last_id"))


def refit_due(pending: int, known: int, share: float = 0.1) -> bool:
    return known == 0 or pending / known > share


def changes(before: DataFrame, after: DataFrame, key: str = "address") -> DataFrame:
    """(key, change): what is new and what dissolved between two states."""
    new = after.join(before, key, "left_anti").select(key, F.lit("new").alias("change"))
    gone = before.join(after, key, "left_anti").select(key, F.lit("dissolved").alias("change"))
    return new.unionByName(gone)


def run_to_memory(stream: DataFrame, name: str, mode: str = "append", prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Everything available, through a memory sink; for tests and small checks."""
    query = (prepare(stream) if prepare else stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
