import pytest
from pyspark.sql import functions as F

from skarn.operators import lifecycle


def test_build_and_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    built = lifecycle.build(docs, vocab_size=12)
    path = str(tmp_path / "passages")
    assert lifecycle.commit(built, path) == 1
    first = lifecycle.read(spark, path)
    assert first.count() == docs.count() and {len(r.mi_vector) for r in first.where("mi_vector is not null").collect()} == {12}
    smaller = first.where("id <> 3").withColumn("ache", F.when(F.col("id") == 4, 0.0).otherwise(F.col("ache")))
    assert lifecycle.commit(smaller, path) == 2
    (tmp_path / "passages" / "version=9").mkdir()  # a write that never finished
    assert {tuple(r) for r in lifecycle.difference(spark, path, 1, 2).collect()} == {(3, "removed"), (4, "changed")}
    assert lifecycle.revert(spark, path, 1) == 3
    assert [(r.version, r.rows) for r in lifecycle.history(spark, path).collect()] == [(1, docs.count()), (2, docs.count() - 1), (3, docs.count())]


def test_eat_origin_and_seal(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    path = str(tmp_path / "passages")
    some = spark.createDataFrame([(k, f"{w} river stone {w} garden") for k, w in enumerate(["red", "green", "blue"])], "doc_id long, text string")
    assert lifecycle.eat(spark, path, some, 6) == 1
    assert lifecycle.origin(lifecycle.read(spark, path)).count() == 0
    assert lifecycle.commit(lifecycle.set_origin(lifecycle.read(spark, path), "what we are"), path) == 2
    more = spark.createDataFrame([(7, "Red  river stone red garden"), (8, "a new stone garden"), (9, "short"), (10, None)], "doc_id long, text string")
    assert lifecycle.eat(spark, path, more, 6) == 3
    grown = lifecycle.read(spark, path)
    assert {r.id for r in grown.collect()} == {-1, 0, 1, 2, 8}
    assert [r.text for r in lifecycle.origin(grown).collect()] == ["what we are"]
    replaced = lifecycle.set_origin(grown, "what we became")
    assert [r.text for r in lifecycle.origin(replaced).collect()] == ["what we became"] and replaced.count() == 5
    assert lifecycle.maintain(spark, path, 6) == 4 and lifecycle.compact(spark, path, 6, half_life=2.0) == 5
    assert {r.id for r in lifecycle.read(spark, path).collect()} == {-1, 0, 1, 2, 8}
    lifecycle.seal(spark, path)
    assert lifecycle.sealed(spark, path) and lifecycle.read(spark, path).count() == 5
    with pytest.raises(lifecycle.Sealed):
        lifecycle.commit(grown, path)
    with pytest.raises(lifecycle.Sealed):
        lifecycle.eat(spark, path, docs, 6)
