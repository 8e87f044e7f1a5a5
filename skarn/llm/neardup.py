"""Near-duplicate classes at the similarity of five-word shingle sets.

Search: MinHash of a text's distinct five-word shingles, BANDS bands of ROWS values.  Two texts
at Jaccard similarity 0.8 agree in some band with probability 0.99, whatever kind of edit made
the one from the other.  Decision: a pair that meets in a band is linked only if the Jaccard
similarity of the two sets, taken from the sets themselves, is SIMILAR or more.

Under each band key all are first compared with one of them, so a large group of copies costs a
link per member.  Of the keys whose members are then in several classes, members are compared by
their MinHash values, block with block of BLOCK members, and what is likely similar is verified
on the sets in the same way, as far as it is not yet in one class.  No group is cut short, gathered
in a task or written out as its pairs: a block gives no more links than join its classes.

Texts with equal sets are one node.  Links of the exact operator (``simhash``: three-word
shingles, two bits of 64) are added, so its classes are never split here.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from skarn.core.durable import cut
from skarn.llm import simhash
from skarn.llm.lm import bloom, maybe
from skarn.llm.tokens import _mixed, word_hashes
from skarn.operators.components import connected_components

SHINGLE = 5
SIMILAR = 0.8
BANDS = 20
ROWS = 7
#: Members of a key that are compared with as many others in one go.
BLOCK = 2048
BLOCK_BYTES = 1 << 25
#: Estimated similarity from which a pair is verified; of pairs at 0.8 three in 2,000 are estimated lower.
PROMISING = 0.7


_RANDOM = np.random.default_rng(5).integers(0, 1 << 63, (3, BANDS * ROWS), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(text: pa.Array) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct five-word shingles; fewer words are one shingle."""
    for _, _, h, bounds in word_hashes(text):
        rolled = _rolled([h[k : max(k, len(h) - SHINGLE + 1 + k)] for k in range(SHINGLE)])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(rolled[a : b - SHINGLE + 1]) if b - a >= SHINGLE else _rolled([h[k : k + 1] for k in range(a, b)])


def _rolled(columns: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(columns[0]) if columns else 1, len(columns), np.uint64)
    for x in columns:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + x)
    return out


def _node(own: np.ndarray) -> int:
    return xxh3_64_intdigest(own.tobytes())


def minima(own: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values of a set."""
    salt, factor, _ = _RANDOM
    least = np.full(len(salt), np.iinfo(np.uint64).max)
    for k in range(0, len(own), 4096):
        least = np.minimum(least, ((own[k : k + 4096] ^ salt[:, None]) * factor[:, None]).min(1))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """The keys of a set, one for each band of its values."""
    return _mixed((least * _RANDOM[2]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


_SIGNED = [("fp", T.LongType(), pa.int64()), ("node", T.LongType(), pa.int64()), ("keys", T.ArrayType(T.LongType()), None), ("sig", T.BinaryType(), pa.binary()), ("shingles", T.LongType(), pa.int64())]


@F.arrow_udf(T.StructType([T.StructField(n, t) for n, t, _ in _SIGNED]))
def _signed(text: pa.Array) -> pa.Array:
    """SimHash fingerprint, set, band keys, a byte of every MinHash value, and the set's size."""
    fps = np.fromiter((simhash.fingerprint(x.as_py()) for x in text), np.uint64, len(text))
    nodes, keys = np.zeros(len(text), np.uint64), np.zeros((len(text), BANDS), np.uint64)
    sigs, sizes = [], np.zeros(len(text), np.int64)
    for k, own in enumerate(shingle_sets(text)):
        least = minima(own)
        nodes[k], keys[k], sizes[k] = _node(own), bands(least), len(own)
        sigs.append(least.astype(np.uint8).tobytes())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
    return pa.StructArray.from_arrays([pa.array(fps.view(np.int64)), pa.array(nodes.view(np.int64)), lists, pa.array(sigs, pa.binary()), pa.array(sizes)], [n for n, _, _ in _SIGNED])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows alike in the first three columns, which come one after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        by = [batch.column(k).to_numpy() for k in range(3)]
        edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in by], 0)) + 1
        for a, b in itertools.pairwise([0, *edges.tolist(), batch.num_rows]):
            here = tuple(x[a] for x in by)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _near(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows) that are in unlike classes and likely similar, of two blocks of a key, or within one."""
    _, p, q, block, _, component = (group.column(k).to_numpy() for k in range(6))
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    one, two = np.flatnonzero(block == p), np.flatnonzero(block == q)
    for k, row in enumerate(one.tolist()):
        others = two[k + 1 :] if p[0] == q[0] else two
        others = others[component[others] != component[row]]
        equal = np.count_nonzero(sig[others] == sig[row], axis=1) / (BANDS * ROWS)
        near = others[(equal - 1 / 256) / (255 / 256) >= PROMISING]
        if len(near):
            yield row, near


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have a likely similar one under their key, each at most once."""
    for group in _groups(batches):
        wanted = np.zeros(group.num_rows, bool)
        for row, near in _near(group):
            wanted[row] = True
            wanted[near] = True
        if wanted.any():
            yield from group.filter(pa.array(wanted)).combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (src, dst) of a spanning forest of what is similar in a group of promising rows with their sets."""
    for group in _groups(batches):
        node, component = group.column("node").to_pylist(), group.column("component").to_pylist()
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("own")]
        root = {c: c for c in component}

        def find(x: int, root: dict[int, int] = root) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for row, near in _near(group):
            for other in near.tolist():
                a, b = find(component[row]), find(component[other])
                if a != b and _similarity(own[row], own[other]) >= SIMILAR:
                    root[a] = b
                    links.append((node[row], node[other]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["src", "dst"])


_PLACED = "key long, p int, q int, block int, node long, component long, sig binary"


def _within(placed: DataFrame, signed: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst): similar members of one key in unlike classes, as many links as join the classes.

    Members meet block by block, so no task holds more than two blocks of a key, of BLOCK members
    or BLOCK_BYTES of sets each on average.
    """
    found = cut(placed.join(signed, "node"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("shingles") * 8 / BLOCK_BYTES)).cast("int")
    sizes = cut(found.groupBy("key").agg(blocks.alias("blocks")))
    dealt = found.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = dealt.select("key", "block", "node", "component", "sig", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "component", "sig")
    together = lambda rows: rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    likely = cut(together(met).mapInArrow(_promising, _PLACED))
    return cut(together(likely.join(sets, "node").select(*(x.split()[0] for x in _PLACED.split(", ")), "own")).mapInArrow(_linked, "src long, dst long"))


def _similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


@F.arrow_udf(T.DoubleType())
def _jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    out = np.zeros(len(a))
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        out[k] = _similarity(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)))
    return pa.array(out)


def _sets(text: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, own) of the wanted nodes."""
    held = text.sparkSession.sparkContext.broadcast(bloom(wanted.select(F.col("node").alias("code"))))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found, size = [], [], 0
            for own in shingle_sets(batch.column(0)):
                node = np.array([_node(own)], np.uint64)
                if maybe(held.value, node)[0]:
                    nodes.append(node.view(np.int64)[0])
                    found.append(own.tobytes())
                    size += len(found[-1])
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], ["node", "own"])
                    nodes, found, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], ["node", "own"])

    return text.mapInArrow(find, "node long, own binary").groupBy("node").agg(F.first("own").alias("own"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose sets are similar."""
    of_src, of_dst = (sets.select(F.col("node").alias(c), F.col("own").alias(f"{c}_own")) for c in ("src", "dst"))
    both = pairs.join(of_src, "src").join(of_dst, "dst")
    return cut(both.where(_jaccard("src_own", "dst_own") >= SIMILAR).select("src", "dst"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) for every row; component is the least id of the class, nulls aside."""
    signed = docs.select(F.col(id_col).alias("id"), _signed(F.col(text_col)).alias("s")).select("id", "s.*")
    named = cut(signed.withColumn("exact", F.xxhash64(F.lit(1), "fp")))
    nodes = cut(named.groupBy("node", "exact", "fp").agg(F.min("id").alias("least")))
    fps = nodes.groupBy("fp").agg(F.lit(1).alias("one")).select("fp")
    close = simhash.links(fps).select(F.xxhash64(F.lit(1), "src").alias("src"), F.xxhash64(F.lit(1), "dst").alias("dst"))
    of_exact = nodes.select(F.col("node").alias("src"), F.col("exact").alias("dst"))

    met = cut(named.groupBy("node").agg(F.first("keys").alias("keys")).select(F.explode("keys").alias("key"), "node"))
    firsts = cut(met.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"))
    met = cut(met.join(firsts, "key"))
    sets = cut(_sets(docs.select(F.col(text_col).alias("text")), met.select("node")))
    pairs = cut(met.where("first < node").select(F.col("first").alias("src"), F.col("node").alias("dst")).distinct())
    found = connected_components(_verified(pairs, sets).unionByName(close).unionByName(of_exact))
    found = cut(found)
    placed = cut(met.select("key", "node").join(found, "node"))
    apart = cut(placed.groupBy("key").agg((F.min("component") < F.max("component")).alias("apart")).where("apart").select("key"))
    placed = cut(placed.join(apart, "key"))
    more = _within(placed, named.groupBy("node").agg(F.first("sig").alias("sig"), F.first("shingles").alias("shingles")), sets)
    found = connected_components(more.unionByName(found.select(F.col("node").alias("src"), F.col("component").alias("dst"))))

    placed = cut(nodes.select("node", "exact", "least").join(found, "node").select("node", "exact", "least", F.col("component").alias("root")))
    least = cut(placed.groupBy("root").agg(F.min("least").alias("component")))
    of_node = placed.join(least, "root").groupBy("node").agg(F.min("component").alias("component"))
    return named.select("id", "node").join(of_node, "node").select("id", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each class the row with the smallest id stays.

    Rows alike in id and text count as one; rows without an id stay if one of them does; an
    empty table gives no rows.
    """
    found = classes(docs, id_col, text_col)
    kept = cut(found.where(F.col("id").eqNullSafe(F.col("component"))).groupBy(F.col("id").alias("_kept")).agg(F.count(F.lit(1)).alias("_n")))
    semi = lambda some: docs.join(some.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_kept")), "left_semi")
    if not kept.where("_n > 1").limit(1).count():
        return semi(kept)
    return semi(kept.where("_n = 1")).unionByName(semi(kept.where("_n > 1")).dropDuplicates([id_col, text_col]))
