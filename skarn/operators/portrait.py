"""Portraits: what a corpus and its formations are named by, and where it is strong or silent."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.core.durable import cut
from skarn.functions import lexicon as L

STEM = 5


def word_uses(members: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, tf, df): uses and passages of words of four letters and more, and passages of the empty word, which
    every passage has once; one look at the texts, one shuffle.

    A batch's words are numbered, and added up by numbers before they are rows.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().dictionary_encode()
            size = len(flat.dictionary)
            own = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            of = keys.indices.to_numpy().astype(np.int64)
            once, tf = np.unique(own * size + flat.indices.to_numpy(), return_counts=True)  # a passage and a word
            place, at = np.unique(of[once // max(size, 1)] * size + once % max(size, 1), return_inverse=True)
            passages = np.bincount(of, minlength=len(keys.dictionary)).astype(np.int64)
            columns = [
                keys.dictionary.take(pa.array(np.concatenate([place // max(size, 1), np.arange(len(passages))]))),
                pa.concat_arrays([flat.dictionary.take(pa.array(place % max(size, 1))), pa.array([""] * len(passages), flat.dictionary.type)]),
                *(pa.array(np.concatenate([np.bincount(at, x, len(place)).astype(np.int64), passages])) for x in (tf, np.ones(len(once)))),
            ]
            for k in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([c[k : k + (1 << 16)] for c in columns], ["key", "word", "tf", "df"])

    flat = members.select(F.col(key).cast("string").alias("key"), words.alias("words")).mapInArrow(count, "key string, word string, tf long, df long")
    return flat.groupBy("key", "word").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def names(members: DataFrame, key: str, text: str, top: int = 3, least: int = 2, share: float = 0.08, left_out: Iterable[str] = L.VOCAB_STOPWORDS) -> DataFrame:
    """(key, name): the words that tell a formation's passages from the corpus, joined by _.

    First come words in at least ``share`` of the passages (``least`` or more), by uses a passage times
    the square of their rarity times the root of their length.  A formation without any takes, of its
    50 most used words, ten by uses times length; a name of one word is filled up from its 30 most
    used.  Words that begin with the same five letters count once.  Ties by word.  ``left_out``
    stands for a list of function words.
    """
    whole = cut(word_uses(members, key, text))
    n = whole.where("word = ''").select("key", F.col("df").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    uses = whole.where("word <> ''")
    spoken = ~F.col("word").isin(list(left_out))
    telling = F.col("df") >= F.greatest(F.lit(least), F.floor(F.col("n") * share))
    told = uses.join(F.broadcast(n), "key").where(spoken & telling)  # a row a formation
    spread = uses.join(told.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("df").alias("gdf"))
    rarity = F.log((F.col("total") + 1) / (F.col("gdf") + 1))
    rated = told.join(spread, "word").crossJoin(F.broadcast(total))  # one row
    first = cut(rated.select("key", "word", F.lit(1).alias("tier"), F.round(F.col("tf") / F.col("n") * rarity * rarity * F.sqrt(F.length("word")), 9).alias("score")))
    by_use = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("tf"), "word"))
    most = cut(uses.withColumn("place", by_use).where("place <= 50")).where(spoken)  # a plain bound is applied before rows are moved
    used = most.withColumn("kept", F.row_number().over(Window.partitionBy("key").orderBy("place")))
    second = used.where("kept <= 10").join(first.select("key").distinct(), "key", "left_anti").select("key", "word", F.lit(2).alias("tier"), (F.col("tf") * F.length("word")).cast("double").alias("score"))
    third = most.where("place <= 30").select("key", "word", F.lit(3).alias("tier"), F.col("tf").cast("double").alias("score"))
    order = ("tier", F.desc("score"), "word")
    stems = Window.partitionBy("key", F.substring("word", 1, STEM)).orderBy(*order)
    single = first.unionByName(second).unionByName(third).withColumn("k", F.row_number().over(stems)).where("k = 1")
    ranked = single.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    kept = ranked.where(F.col("rank") <= max(top, 2)).where(((F.col("tier") < 3) & (F.col("rank") <= top)) | (F.col("rank") <= 2))
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"])
    return kept.groupBy("key").agg(F.upper(F.array_join(words, "_")).alias("name")).select(F.col("key").cast(members.schema[key].dataType).alias(key), "name")


def dimensions(rows: DataFrame, id_col: str, vector: str, text: str, silent: float = 0.0, quote: int = 200) -> DataFrame:
    """(dimension, total, share, rank, strongest, quote, absent): activation of a corpus by dimension.

    ``strongest`` is the passage that the dimension leads most in, ties by id; a dimension that has no
    more than ``silent`` of all activation is absent.
    """
    each = rows.select(F.col(id_col).alias("id"), F.substring(text, 1, quote).alias("head"), F.posexplode(vector).alias("place", "x"))
    sums = each.groupBy("place").agg(F.sum("x").alias("total"), F.max_by(F.struct("id", "head"), F.struct(F.col("x"), -F.col("id"))).alias("best"))
    whole = sums.agg(F.sum("total").alias("whole"))
    share = F.when(F.col("whole") > 0, F.col("total") / F.col("whole")).otherwise(0.0)
    out = sums.crossJoin(F.broadcast(whole)).withColumn("share", share)  # eight rows and one
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("share", 9)), "place"))
    label = F.element_at(F.array(*map(F.lit, L.DIMENSIONS)), F.col("place") + 1)
    return out.select(label.alias("dimension"), "total", "share", rank.alias("rank"), F.col("best.id").alias("strongest"), F.trim("best.head").alias("quote"), (F.col("share") <= silent).alias("absent"))


def compare(before: DataFrame, after: DataFrame, item: str) -> DataFrame:
    """One row: how many items stay, come and go, the share that stays of the larger side, and the churn of both."""
    b, a = (t.select(F.col(item).alias("item")).distinct().withColumn(side, F.lit(True)) for t, side in ((before, "b"), (after, "a")))
    joined = b.join(a, "item", "full_outer")
    count = lambda c: F.count(F.when(c, 1))
    old, new = F.col("b").isNotNull(), F.col("a").isNotNull()
    out = joined.agg(count(old & new).alias("stable"), count(new & ~old).alias("added"), count(old & ~new).alias("removed"))
    larger = F.greatest(F.col("stable") + F.col("added"), F.col("stable") + F.col("removed"), F.lit(1))
    union = F.greatest(F.col("stable") + F.col("added") + F.col("removed"), F.lit(1))
    return out.withColumn("stability", F.col("stable") / larger).withColumn("churn", (F.col("added") + F.col("removed")) / union)


def rank_drift(before: DataFrame, after: DataFrame, top: int = 200, least: int = 5, most: int = 50) -> DataFrame:
    """(term, change): places that the most used terms rose or fell by, a missing one ranking last; the ``most`` largest."""
    order = lambda t, c: t.orderBy(F.desc("cf"), "term").limit(top).select("term", F.row_number().over(Window.orderBy(F.desc("cf"), "term")).alias(c))
    b, a = order(before, "old"), order(after, "new")
    joined = b.join(a, "term", "full_outer").withColumn("last", F.greatest(F.count("old").over(Window.partitionBy()), F.count("new").over(Window.partitionBy())) + 1)
    change = (F.coalesce("old", "last") - F.coalesce("new", "last")).cast("long")
    moved = joined.select("term", change.alias("change")).where(F.abs("change") >= least)
    return moved.orderBy(F.desc(F.abs("change")), "term").limit(most)


def recommend(presence_rows: DataFrame, drift: DataFrame) -> DataFrame:
    """(term, dimension, weight) of seed terms for the next cycle: 3 where a dimension is hardly present, 1.5 where
    it is all there, else 2; half more, 3 at most, for a term that fell by over ten places."""
    from skarn.operators.profile import seed_table

    base = F.when(F.col("share") < 0.2, 3.0).when(F.col("share") > 0.8, 1.5).otherwise(2.0)
    joined = seed_table(presence_rows.sparkSession).join(presence_rows.select("dimension", "share"), "dimension").join(drift, "term", "left")
    weight = F.when(F.col("change") < -10, F.least(base + 0.5, F.lit(3.0))).otherwise(base)
    return joined.select("term", "dimension", weight.alias("weight"))


def misread(lists: DataFrame, window: int = 10, least: int = 3, top: int = 15, threshold: float = 0.5) -> DataFrame:
    """(term, dimension, overlap, severity, uses) of seed terms whose neighbours are not their dimension's other seeds.

    The ``top`` words within ``window`` places of a term (three letters and more, no stop words, not
    itself; ties by word) are held against its siblings; terms of fewer than ``least`` uses or without
    neighbours are not judged.
    """
    from skarn.operators.profile import seed_table

    seeds = seed_table(lists.sparkSession).withColumnRenamed("term", "seed")
    every = F.array(*(F.lit(t) for terms in L.SEEDS.values() for t in terms))
    some = lists.where(F.arrays_overlap("words", every))
    hits = some.select("words", F.posexplode("words").alias("pos", "seed")).where(F.array_contains(every, F.col("seed")))
    start = F.greatest(F.lit(0), F.col("pos") - window)
    around = F.concat(F.slice("words", start + 1, F.col("pos") - start), F.slice("words", F.col("pos") + 2, F.lit(window)))
    uses = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("uses"))
    near = hits.select("seed", F.explode(around).alias("word")).where((F.length("word") >= 3) & ~F.col("word").isin(L.VOCAB_STOPWORDS) & (F.col("word") != F.col("seed")))
    counts = near.groupBy("seed", "word").agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("n"), "word"))
    leading = counts.withColumn("rank", best).where(F.col("rank") <= top).join(F.broadcast(seeds), "seed")  # the seed terms alone
    sibling = F.broadcast(seeds.select(F.col("seed").alias("word"), F.col("dimension").alias("kin")))
    met = leading.join(sibling, "word", "left").groupBy("seed", "dimension").agg(F.count(F.when(F.col("kin") == F.col("dimension"), 1)).alias("met"))
    sizes = F.create_map(*(F.lit(x) for d, terms in L.SEEDS.items() for x in (d, len(terms) - 1)))
    out = met.join(uses, "seed").where(F.col("uses") >= least).withColumn("overlap", F.col("met") / sizes[F.col("dimension")])
    return out.where(F.col("overlap") < threshold).select(F.col("seed").alias("term"), "dimension", "overlap", (1 - F.col("overlap")).alias("severity"), "uses")
