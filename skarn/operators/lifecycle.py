"""Builds and versions: the passage table, versioned snapshots, their history and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.functions import grammar as G
from skarn.functions import text as X
from skarn.operators import corpus


def build(docs: DataFrame, vocab_size: int = 200, id_col: str = "doc_id", text_col: str = "text", half_life: float | None = None, lexicon: G.Lexicon | None = None) -> DataFrame:
    """The passage table: id, text, mi_vector, ache, keywords, cognitive vector, chain, address.

    Statistics are learned from all passages first, then every passage is vectorised with the
    frozen vocabulary.  With ``half_life`` (in passages, ids being their order) old words fade from it.
    """
    lists = corpus.token_lists(docs, id_col, text_col)
    stats, totals, vocab, links = corpus.learn(lists, vocab_size, half_life=half_life)
    ache = corpus.surprise(lists, stats, totals)
    vectors = corpus.dense(corpus.vectors(lists, vocab, links), vocab_size)
    words = corpus.keywords(lists, stats, totals, links).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("keywords"))
    parsed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), G.parser(lexicon)(F.col(text_col)).alias("p"), X.structural(F.col(text_col)).alias("s"))
    digested = parsed.withColumn("cognitive_vector", G.activation(F.col("p.vector"), F.col("s")))
    chained = digested.select("id", "text", "cognitive_vector", G.first_chain(F.col("p.chains"), F.col("cognitive_vector")).alias("chain"))
    joined = chained.join(vectors, "id", "left").join(ache, "id", "left").join(words, "id", "left")
    return joined.select("id", "text", F.col("vector").alias("mi_vector"), "ache", "keywords", "cognitive_vector", "chain", X.address(F.col("cognitive_vector")).alias("address"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm):
        return []
    names = [s.getPath() for s in fs.listStatus(jvm)]
    whole = [p.getName() for p in names if p.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in whole)


class Sealed(RuntimeError):
    """A sealed table was written to."""


def _flag(spark: SparkSession, path: str, name: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def seal(spark: SparkSession, path: str) -> None:
    """No version is added from now on; reading, history and differences go on."""
    fs, flag = _flag(spark, path, "_SEALED")
    fs.create(flag, True).close()


def sealed(spark: SparkSession, path: str) -> bool:
    fs, flag = _flag(spark, path, "_SEALED")
    return fs.exists(flag)


def commit(table: DataFrame, path: str) -> int:
    """Writes a new version; it counts once its write has succeeded.  A sealed table takes none."""
    if sealed(table.sparkSession, path):
        raise Sealed(f"{path} is sealed")
    version = max(_versions(table.sparkSession, path), default=0) + 1
    table.write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version, the newest by default."""
    return spark.read.parquet(f"{path}/version={version or max(_versions(spark, path))}")


def history(spark: SparkSession, path: str) -> DataFrame:
    """(version, rows) of every version."""
    rows = [(v, read(spark, path, v).count()) for v in _versions(spark, path)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("version", T.IntegerType()), T.StructField("rows", T.LongType())]))


def difference(spark: SparkSession, path: str, before: int, after: int, key: str = "id") -> DataFrame:
    """(key, change) between two versions: added, removed, changed."""
    hashed = lambda v, n: read(spark, path, v).select(key, F.xxhash64(F.to_json(F.struct("*"))).alias(n))
    joined = hashed(before, "h0").join(hashed(after, "h1"), key, "full_outer")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return joined.select(key, change.alias("change")).where("change is not null")


def revert(spark: SparkSession, path: str, version: int) -> int:
    """An old version's rows as the newest version."""
    return commit(read(spark, path, version), path)


def set_origin(table: DataFrame, text: str, origin_id: int = -1) -> DataFrame:
    """The table (id, text, ...) with its one protected row: what the corpus says of itself comes first and stays."""
    marked = table if "protected" in table.columns else table.withColumn("protected", F.lit(False))
    typed = dict(marked.dtypes)
    values = {"id": F.lit(origin_id), "text": F.lit(text), "protected": F.lit(True)}
    row = table.sparkSession.range(1).select(*(values.get(c, F.lit(None)).cast(typed[c]).alias(c) for c in marked.columns))
    return marked.where(~F.col("protected")).unionByName(row)


def origin(table: DataFrame) -> DataFrame:
    """The protected row, if there is one."""
    return table.where("protected") if "protected" in table.columns else table.limit(0)


def ingest(table: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """(id, text) rows to be learned: those of the table and new texts, equal texts once (the smallest id).

    Texts below ``least`` characters are left out; protected rows are no passages.
    """
    own = table.where(~F.col("protected")) if "protected" in table.columns else table
    fresh = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length(X.strip(F.col("text"))) >= least)
    both = own.select("id", "text").unionByName(fresh)
    return both.groupBy(X.content_hash(X.normalised(F.col("text"))).alias("norm")).agg(F.min_by("text", "id").alias("text"), F.min("id").alias("id")).select("id", "text")


def eat(spark: SparkSession, path: str, docs: DataFrame, vocab_size: int = 200, id_col: str = "doc_id", text_col: str = "text", **options) -> int:
    """Learns new passages with the old ones and writes the next version; the protected row is carried over."""
    versions = _versions(spark, path)
    if not versions:
        return commit(build(docs, vocab_size, id_col, text_col, **options), path)
    old = read(spark, path, versions[-1])
    grown = build(ingest(old, docs, id_col, text_col), vocab_size, "id", "text", **options)
    kept = origin(old)
    return commit(grown.unionByName(kept, allowMissingColumns=True).fillna(False, ["protected"]) if "protected" in old.columns else grown, path)


def maintain(spark: SparkSession, path: str, vocab_size: int = 200, **options) -> int:
    """Learns the newest version again."""
    return eat(spark, path, read(spark, path).select("id", "text").limit(0), vocab_size, "id", "text", **options)


def compact(spark: SparkSession, path: str, vocab_size: int = 200, half_life: float = 500.0, **options) -> int:
    """Learns the newest version again, with a vocabulary that old words fade from."""
    return maintain(spark, path, vocab_size, half_life=half_life, **options)
