"""Connected components by randomised edge contraction.

Each round orders the nodes by a hash salted with the round number, maps every node to the
least of itself and its neighbours, and rewrites the edges between the images.  A fresh order
per round shrinks any graph by a constant factor in expectation, so long paths cost
logarithmically many rounds.  Hubs are safe: the minimum is a partially aggregated group-by,
and a rewrite joins edges with a table that has one row per node, whose large partitions
adaptive execution can split.  Edges and maps stay distributed; only counts reach the driver.
Every graph takes the same rounds; its tables have a partition per PART_ROWS rows, so a small
graph, or the small rest of a large one, does not pay for thousands of empty tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.core.durable import cut

#: Rows of a partition of the rounds' tables, at 16 to 24 bytes a row.
PART_ROWS = 500_000
#: Of a graph along a sequence: bits of the width of a block of ids, and by how many it grows a round.
BLOCK_BITS, MORE_BITS = 13, 6


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Edges are undirected; repeated edges and self-loops are allowed, edges with a null end are
    ignored.  An empty table gives an empty result.
    """
    u, v = F.col(src), F.col(dst)
    ends = edges.where(u.isNotNull() & v.isNotNull()).groupBy(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
    ends = cut(ends.agg(F.lit(1).alias("one")).select("u", "v"))
    live = ends.where("u <> v")
    maps: list[DataFrame] = []
    while left := live.count():
        if len(maps) >= max_rounds:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
        parts = -(-left // PART_ROWS)
        live = live.coalesce(parts)
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), F.col(c)).alias("h"), F.col(c).alias("n"))
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        step = cut(least.select("u", F.least(rank("u"), F.col("m"))["n"].alias("p")).coalesce(parts))
        maps.append(step)
        to_u = step.select(F.col("u"), F.col("p").alias("pu"))
        to_v = step.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = live.join(to_u, "u").join(to_v, "v").where("pu <> pv")
        live = cut(
            moved.groupBy(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .agg(F.lit(1).alias("one"))
            .select("u", "v")
            .coalesce(parts)
        )
    loops = ends.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    if not maps:
        return loops.select("node", F.col("root").alias("component"))
    roots = maps[-1].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for step in reversed(maps[:-1]):
        onward = roots.select(F.col("node").alias("p"), F.col("root"))
        roots = step.join(onward, "p", "left").select(F.col("u").alias("node"), F.coalesce("root", "p").alias("root"))
    roots = cut(roots)
    least = cut(roots.groupBy("root").agg(F.min("node").alias("component")))  # cut, so that a large class can be split in the join
    found = roots.join(least, "root").select("node", F.least("node", "component").alias("component"))
    alone = loops.join(roots.select("node"), "node", "left_anti").select("node", F.col("root").alias("component"))
    return found.unionByName(alone)


def _roots(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number reachable from each of 0..max, over edges of numbers."""
    root = np.arange(max(int(u.max()), int(v.max())) + 1)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def sequence_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) as ``connected_components`` has it, of edges between near places of a sequence (integers).

    A block of ids joins its own edges, and hands on only those of its classes that an edge links with
    another block; the next round does the same with the classes, in blocks of 64 times the width, until no
    edge leaves its block.  A block holds the edges that touch it, so its size is bounded by the reach
    of the edges; any graph of integers gives the right classes.
    """
    u, v = F.col(src).cast("long"), F.col(dst).cast("long")
    live = edges.where(u.isNotNull() & v.isNotNull()).select(u.alias("u"), v.alias("v"))
    bits = BLOCK_BITS
    found = None

    def contract(key: tuple, block: pa.Table) -> pa.Table:
        at = key[0].as_py()
        nodes, ends = np.unique(np.concatenate([block.column("u").to_numpy(), block.column("v").to_numpy()]), return_inverse=True)
        root = _roots(ends[: len(block)], ends[len(block) :])
        own = (nodes >> at["bits"] if at["bits"] < 63 else nodes * 0) == at["k"]
        least = np.full(len(nodes), len(nodes))
        np.minimum.at(least, root[own], np.flatnonzero(own))  # every edge touches its block, so every class has a node of its own
        return pa.table({"node": nodes, "root": nodes[least[root]], "own": own})

    while True:
        number = lambda c: F.shiftright(c, bits) if bits < 63 else F.lit(0).cast("long")  # noqa: B023, E731
        block = F.explode(F.array_distinct(F.array(number("u"), number("v")))).alias("k")
        keyed = live.select("u", "v", block).select("u", "v", F.struct("k", F.lit(bits).alias("bits")).alias("block"))
        classes = cut(keyed.groupBy("block").applyInArrow(contract, "node long, root long, own boolean"))
        own = classes.where("own").select("node", "root")
        if found is None:
            found = own
        else:
            onward = own.select(F.col("node").alias("root"), F.col("root").alias("onward"))
            found = found.join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root"))
        linked = classes.where("not own and node > root").select("node", F.col("root").alias("v"))  # its block hands on the other way round too
        if linked.isEmpty():
            return found.select("node", F.col("root").alias("component"))
        live = linked.join(own.withColumnRenamed("root", "u"), "node").select("u", "v")
        bits += MORE_BITS
