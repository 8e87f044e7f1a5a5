from collections import Counter

from pyspark.sql import functions as F

from skarn.operators import corpus
from skarn.streaming import streams


def test_stream_statistics_equal_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    landing = str(tmp_path / "in")
    docs.repartition(5).write.parquet(landing)
    stream = streams.folder(spark, landing, docs._jdf.schema().toDDL(), per_trigger=2)
    streams.eat(stream, str(tmp_path / "stats"), "doc_id", "text", checkpoint=str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in streams.eaten(spark, str(tmp_path / "stats")).collect()}
    assert got == {tuple(r) for r in corpus.token_stats(corpus.token_lists(docs)).collect()}


def test_duplicates_and_throttle(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("text", F.concat_ws(" ", "event_type", "user_id"))
    landing = str(tmp_path / "in")
    events.coalesce(1).write.parquet(landing)
    source = streams.folder(spark, landing, events._jdf.schema().toDDL())
    once = streams.run_to_memory(streams.unseen(source, "ts", memory="3650 days"), "once").collect()
    assert len(once) == len({r.text for r in once}) == events.select("text").distinct().count()
    slow = streams.run_to_memory(streams.throttled(source, "ts", "user_id", late="3650 days"), "slow").collect()
    want = events.select("user_id", F.window("ts", "10 minutes").alias("w")).distinct().count()
    assert len(slow) == want
    counts = streams.run_to_memory(streams.windowed_counts(source, "ts", "event_type", late="1 second"), "counts", "complete")
    assert counts.agg(F.sum("n")).first()[0] == events.count()


def test_envelopes_changes_and_fan_out(spark):
    rows = spark.createDataFrame([('{"text": "a"}',), ('{"raw": "r", "text": "t"}',), ("plain",)], "value string")
    assert [r[0] for r in rows.select(streams.text_of()).collect()] == ["a", "r", "plain"]
    before, after = (spark.createDataFrame([(x,) for x in s], "address string") for s in ("ab", "bc"))
    assert Counter(map(tuple, streams.changes(before, after).collect())) == Counter([("c", "new"), ("a", "dissolved")])
    assert streams.fan_out(rows, before.withColumnRenamed("address", "member")).count() == 6
    assert streams.refit_due(11, 100) and not streams.refit_due(10, 100)
