"""Mixing sources to target weights, in DataFrame operations only.

Documents get hash-random keys; rows alike in id, source and size, such as rows without an id, are
counted first and go on as one, since one key is theirs.  The key space is cut into about sqrt(rows) equal ranges, which
random keys fill evenly, so a source of any share is spread over all of them: within each
(source, range) rows are sorted and summed, the sums of ranges are summed over each source, and
every document learns how many of its source's words come before it.  Neither step gives one
task more than about sqrt(rows) rows of a source.  A source's budget is then cut exactly: whole
epochs first, the rest in key order, the document at the cut in part.

Defined results: a null or wordless text has size 0 and is never taken; a null source is a
source of its own, the last; repeated rows are mixed as rows; an empty table gives no rows; columns
``mix_size``, ``mix_epochs`` and ``mix_taken`` of the input are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.core.durable import cut

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20240229
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Up to so many sources (at about 100 bytes each) the table of cuts is broadcast, beyond them it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(seed: int, row_id: Column, size: Column) -> Column:
    """63 random bits, the same for a row in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), row_id, size), 1)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``target`` for each row of (source, source_size): shares by weight, at most max_epochs times the size.

    Sources are filled in the order of cap over weight: the level at which the water stands is
    the highest that what is left after the earlier caps gives to the weights still open.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1
    cap = (F.col("source_size") * max_epochs).cast("double")
    out = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    before = everything.orderBy(cap / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * max_epochs).over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = out.withColumn("level", left.cast("double") / open_weight.cast("double"))
    return out.withColumn("target", F.least(cap, F.col("weight") * F.max("level").over(everything))).select("source", "source_size", "target")


def prefixes(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(id, source, size), copies, key, before (words of the source ahead of them), source_size, target, epochs, rest."""
    grouped = cut(sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    ranges = max(1, math.isqrt(grouped.count()))
    keyed = grouped.withColumn("key", random_key(seed, F.col("id"), F.col("size")))
    keyed = keyed.withColumn("range", F.shiftright(F.shiftright("key", 32) * F.lit(ranges).cast("long"), 31))
    sums = keyed.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("range_size"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)))
    wanted = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    budget = F.floor("target")
    wanted = wanted.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    wanted = wanted.withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long")).withColumnRenamed("source", "s")
    offsets = offsets.join(wanted, F.col("source").eqNullSafe(F.col("s"))).select(
        "s", F.col("range").alias("r"), "offset", "source_size", "target", "epochs", "rest"
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    joined = summed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    return joined.withColumn("before", F.col("offset") + F.col("inside")).drop("s", "r", "offset", "inside")


def taken_words(copy: Column) -> Column:
    """Words that the mix takes of a copy (from 0) of a row of ``prefixes``."""
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - copy * F.col("size")))
    return F.col("epochs") * F.col("size") + part


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))


def mix_plan(sized: DataFrame, **options) -> DataFrame:
    """id, source, size, source_size, target, taken for every row of (id, source, size)."""
    planned = prefixes(sized, **options).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return planned.select("id", "source", "size", "source_size", "target", taken_words(F.col("copy")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED, **options) -> DataFrame:
    """``docs`` with mix_size, mix_epochs and mix_taken; texts are not shuffled.

    The plan is cut at one row per source; each row of ``docs`` then compares its own key with
    its source's cut.  Rows alike in id, source and size share what falls to them evenly.
    """
    docs = docs.drop("mix_size", "mix_epochs", "mix_taken")
    at_cut = prefixes(sizes(docs, id_col, source_col, text_col), seed=seed, **options).withColumnRenamed("before", "first")
    is_cut = (F.col("first") < F.col("rest")) & (F.col("first") + F.col("copies") * F.col("size") >= F.col("rest"))
    cuts = at_cut.groupBy(F.col("source").alias("cut_source")).agg(
        F.max("epochs").alias("epochs"),
        F.max(F.when(is_cut, F.struct("key", F.col("id").alias("id"), "size", F.floor((F.col("rest") - F.col("first")) / F.col("copies")).alias("part")))).alias("cut"),
    )
    cuts = cut(cuts)
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    size = F.col("mix_size")
    sized = docs.withColumn("mix_size", word_count(F.col(text_col)))
    cuts = cuts.select(F.struct("cut_source", "epochs", "cut").alias("_of_source"))
    key = random_key(seed, F.col(id_col), size)
    here = F.struct(key.alias("key"), F.col(id_col).alias("id"), size.alias("size"))
    cut_at = F.col("_of_source.cut")
    there = F.struct(cut_at["key"].alias("key"), cut_at["id"].alias("id"), cut_at["size"].alias("size"))
    part = F.when(cut_at.isNull() | (here > there), 0).when(here < there, size).otherwise(cut_at["part"])
    joined = sized.join(cuts, F.col(source_col).eqNullSafe(F.col("_of_source.cut_source")), "left")
    epochs = F.col("_of_source.epochs")
    return joined.select(*docs.columns, "mix_size", epochs.alias("mix_epochs"), (epochs * size + part).cast("long").alias("mix_taken"))
