"""Couplings: similar neighbours in sequence, their graph, and what is read off it."""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.core.durable import cut
from skarn.functions import similarity as S
from skarn.operators.components import connected_components, sequence_components

REACH = 19


def neighbours(rows: DataFrame, seq: str, reach: int = REACH, start: int | None = None) -> DataFrame:
    """Pairs (columns a_*, b_*) of rows 1..reach apart in ``seq``, by an equi-join on blocks of sequence.

    A row meets its own block and the one before, so no task sees more than three blocks of a
    sequence, and nothing is compared beyond them.  ``start``: only pairs whose later row is new.
    """
    block = F.floor(F.col(seq) / reach)
    left = rows.select(*(F.col(c).alias(f"a_{c}") for c in rows.columns), F.explode(F.array(block, block + 1)).alias("block"))
    right = rows.select(*(F.col(c).alias(f"b_{c}") for c in rows.columns), block.alias("block"))
    if start is not None:
        right = right.where(F.col(f"b_{seq}") >= start)
    gap = F.col(f"b_{seq}") - F.col(f"a_{seq}")
    return left.join(right, "block").where((gap >= 1) & (gap <= reach)).drop("block")


NEARLY, ALIKE, PATHWAY = 0.8, 0.4, 0.4


def couple(rows: DataFrame, seq: str, vector: str, theta: float, reach: int = REACH, start: int | None = None, chains: str | None = None, pathway: str | None = None, order: str | None = None, seconds: str | None = None) -> DataFrame:
    """(src, dst, gamma, wrapping, rule) of neighbours that one of four rules couples, the first that does.

    gamma: theta or more.  chain: nearly theta, and chains alike (``chains``, an array).  pathway:
    the directed coupling of ``pathway`` (a struct of chain, active and ops).  order: both have a
    place in a chain of turns (``order``, with ``seconds``), and gamma blended with nearness reaches
    theta; left out for appended rows (``start``).  Rows with an empty vector couple with none.
    """
    extra = [c for c in (chains, pathway, order, seconds) if c is not None]
    pairs = neighbours(rows.where(F.size(vector) > 0).select(seq, vector, *extra), seq, reach, start)
    a, b = F.col(f"a_{vector}"), F.col(f"b_{vector}")
    both = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    scored = pairs.withColumn("gamma", S.gamma(a, b))
    rule = F.when(F.col("gamma") >= theta, "gamma")
    if chains is not None:
        x, y = both(chains)
        rule = rule.when((F.col("gamma") >= NEARLY * theta) & (S.jaccard(x, y) >= ALIKE), "chain")
    if pathway is not None:
        x, y = both(pathway)
        rule = rule.when(S.directed(x["chain"], y["chain"], x["active"], y["active"], x["ops"], y["ops"]) >= PATHWAY, "pathway")
    if order is not None and start is None:
        x, y = both(order)
        gap = F.abs(y - x)
        lag = F.abs(F.col(f"b_{seconds}") - F.col(f"a_{seconds}")) if seconds is not None else F.lit(0)
        rule = rule.when(x.isNotNull() & y.isNotNull() & (S.blended(F.col("gamma"), gap, lag, F.lit(False)) >= theta), "order")
    kept = scored.withColumn("rule", rule).where("rule is not null")
    return kept.select(F.col(f"a_{seq}").alias("src"), F.col(f"b_{seq}").alias("dst"), "gamma", S.wrapping(S.angle(a, b)).alias("wrapping"), "rule")


def rebuild(rows: DataFrame, seq: str, vector: str, theta: float, stored: DataFrame, whole: bool = False, **rules) -> tuple[str, DataFrame]:
    """(mode, (src, dst, gamma, step)) after rows were appended to those that ``stored`` couples.

    What follows the last coupled row is new; uncoupled rows before it were tried and stay alone.
    none: nothing is new.  appended: only new rows are coupled, with those before them.  full:
    nothing is coupled yet, or ``whole`` asks for it (vectors were moved); stored couplings go.
    """
    last = stored.agg(F.max(F.greatest("src", "dst")).alias("last")).first().last
    newest = rows.agg(F.max(seq).alias("newest")).first().newest
    if whole or last is None:
        return "full", couple(rows, seq, vector, theta, **rules).select("src", "dst", "gamma", F.lit("full").alias("step"))
    kept = stored.select("src", "dst", "gamma", F.lit("kept").alias("step"))
    if newest <= last:
        return "none", kept
    fresh = couple(rows, seq, vector, theta, start=last + 1, **rules).select("src", "dst", "gamma", F.lit("appended").alias("step"))
    return "appended", kept.unionByName(fresh)


def centred(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors minus their mean, scaled to length one."""
    parts = rows.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    means = parts.groupBy("pos").agg(F.avg("x").alias("mean"))
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("mean"))
    moved = rows.crossJoin(F.broadcast(mean)).withColumn("moved", F.zip_with(F.col(vector).cast("array<double>"), "mean", lambda x, m: x - m))
    norm = F.sqrt(F.aggregate("moved", F.lit(0.0), lambda s, x: s + x * x))
    return moved.select(key, F.when(norm > 0, F.transform("moved", lambda x: x / norm)).otherwise(F.col("moved")).alias(vector))


def threshold(scores: DataFrame, column: str, share: float = 0.75) -> Column:
    """Aggregate: the nearest-rank share of scores, at least the golden threshold."""
    ranked = F.array_sort(F.collect_list(column))
    return F.greatest(F.lit(S.golden_threshold()), F.element_at(ranked, (F.floor(F.size(ranked) * share) + 1).cast("int")))


def sampled_pairs(rows: DataFrame, seq: str, vector: str, sample: int = 500, reach: int = REACH, seed: int = 7) -> DataFrame:
    """gamma of ``sample`` neighbour pairs chosen by hash: the bounded sample that the threshold is read from."""
    pairs = neighbours(rows.select(seq, vector), seq, reach)
    return sampled(pairs, f"a_{seq}", f"b_{seq}", sample, seed).select(S.gamma(F.col(f"a_{vector}"), F.col(f"b_{vector}")).alias("gamma"))


def sampled(pairs: DataFrame, a: str, b: str, sample: int = 500, seed: int = 7) -> DataFrame:
    """``sample`` pairs chosen by hash of their ends."""
    return pairs.orderBy(F.md5(F.concat_ws(":", F.lit(seed), a, b)), a, b).limit(sample)


#: Bits of the width of a block of a sequence whose vectors one call compares.
NEAR_BITS = 11


def near_gammas(rows: DataFrame, seq: str, vector: str, reach: int = REACH) -> DataFrame:
    """(src, dst, gamma) of all pairs of rows 1..reach apart in ``seq`` (integers); vectors are of one length.

    A block of the sequence is held with what follows within reach, so a vector is moved once or twice,
    not once a pair.
    """
    place = F.col(seq).cast("long")

    def compare(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("seq").combine_chunks()
        at, n = block.column("seq").to_numpy(), len(block)
        v = np.abs(block.column("v").combine_chunks().flatten().to_numpy()).reshape(n, -1)
        own, out = at >> NEAR_BITS == key[0].as_py(), []
        for k in range(1, n):
            gap = at[k:] - at[:-k]
            if (gap > reach).all():
                break
            i = np.flatnonzero(own[:-k] & (gap >= 1) & (gap <= reach))
            low, high = np.minimum(v[i], v[i + k]).sum(1), np.maximum(v[i], v[i + k]).sum(1)
            out.append((at[i], at[i + k], np.divide(low, high, out=np.zeros(len(i)), where=high > 0)))
        columns = [np.concatenate([x[c] for x in out]) if out else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("src", "dst", "gamma"), columns, strict=True)))

    blocks = F.sequence(F.shiftright(place - reach, NEAR_BITS), F.shiftright(place, NEAR_BITS))
    held = rows.select(place.alias("seq"), F.col(vector).cast("array<double>").alias("v"), F.explode(blocks).alias("block"))
    return held.groupBy("block").applyInArrow(compare, "src long, dst long, gamma double")


def strongest(edges: DataFrame, top: int = 3) -> DataFrame:
    """Each row's strongest couplings, both ways, ties by partner."""
    both = edges.select("src", "dst", "gamma").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "gamma"))
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("gamma"), "dst"))
    return both.withColumn("rank", best).where(F.col("rank") <= top)


def degrees(edges: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(id, degree, state): thick from 5 couplings, thin from 1, else uncoupled."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    joined = rows.select(F.col(key).alias("id")).join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return joined.withColumn("state", F.when(F.col("degree") >= 5, "thick").when(F.col("degree") >= 1, "thin").otherwise("uncoupled"))


def gap_keywords(groups: DataFrame, keywords: str, thick: str) -> DataFrame:
    """(term): keywords of thin groups that no thick group has."""
    terms = groups.select(F.col(thick).alias("thick"), F.explode(keywords).alias("term"))
    return terms.groupBy("term").agg(F.max("thick").alias("any_thick"), F.min("thick").alias("all_thick")).where("not any_thick and not all_thick").select("term")


def coupling_stats(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: distinct edges, mean gamma, density."""
    distinct = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "gamma").dropDuplicates(["a", "b"])
    counted = distinct.agg(F.count(F.lit(1)).alias("edges"), F.avg("gamma").alias("mean_gamma"))
    n = rows.agg(F.count(F.lit(1)).alias("rows"))
    return counted.crossJoin(n).withColumn("density", F.when(F.col("rows") > 1, 2.0 * F.col("edges") / (F.col("rows") * (F.col("rows") - 1))).otherwise(0.0))


def fission(edges: DataFrame, rows_total: int, rounds: int = 10, share: float = 0.15, least: int = 2, sequence: bool = False) -> DataFrame:
    """(node, component) after splitting what is larger than ``share`` of all rows by cutting its weakest couplings.

    Each round takes, within each oversized component, the couplings up to the value that stands at
    30 % of their number (5 more per round, 70 at most) away; gammas count to four places, so that a
    component has at most 10,001 distinct ones and its cut is found without sorting its couplings.
    A component that falls apart keeps its parts of ``least`` rows or more, one that does not stays
    as it is, its couplings cut; without a split the rounds end.  ``sequence``: rows are integers in an
    order, and couplings reach near ones only.
    """
    whole = sequence_components if sequence else connected_components

    def labelled(edges: DataFrame, found: DataFrame) -> DataFrame:
        return cut(edges.select("src", "dst", "gamma").join(found.withColumnRenamed("node", "src"), "src"))

    edges = cut(edges.select("src", "dst", F.round("gamma", 4).alias("gamma")))
    found = cut(whole(edges))
    edges = labelled(edges, found)
    for k in range(rounds):
        sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        large = [r.component for r in sizes.where(F.col("size") > share * rows_total).select("component").collect()]  # fewer than 1/share
        if not large:
            break
        is_large = F.col("component").isin(large)
        values = edges.where(is_large).groupBy("component", "gamma").agg(F.count(F.lit(1)).alias("n"))
        ahead = Window.partitionBy("component").orderBy("gamma")
        ranked = values.withColumn("upto", F.sum("n").over(ahead)).withColumn("total", F.sum("n").over(Window.partitionBy("component")))
        place = F.greatest(F.lit(1), F.floor(F.col("total") * min(30 + 5 * k, 70) / 100))
        cuts = ranked.where(F.col("upto") >= place).groupBy("component").agg(F.min("gamma").alias("cut")).collect()  # a row of each large one
        above = [(F.col("component") == r.component) & (F.col("gamma") > r.cut) for r in cuts]
        kept = edges.where(functools.reduce(operator.or_, above, F.lit(False)))
        parts = whole(kept).withColumnRenamed("component", "part")
        of_large = cut(found.where(is_large).join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")))
        pieces = cut(of_large.groupBy("component", "part").agg(F.count(F.lit(1)).alias("n")))
        split = [r.component for r in pieces.groupBy("component").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("component").collect()]
        if not split:
            break
        fallen = of_large.join(pieces.where(F.col("component").isin(split) & (F.col("n") >= least)).select("part"), "part").select("node", F.col("part").alias("component"))
        found = cut(found.where(~F.col("component").isin(split)).select("node", "component").unionByName(fallen))
        stay = ~F.col("component").isin(split)
        moved = kept.where(~stay).select("src", "dst", "gamma").join(fallen.withColumnRenamed("node", "src"), "src")
        edges = cut(edges.where(~is_large).unionByName(kept.where(stay)).unionByName(moved))
    return found
