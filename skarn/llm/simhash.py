"""SimHash near-duplicates found through a covering code.

Anchors are the words of the perfect Hamming code on bits 0..62 (bit 63 takes part in the exact
comparison only): every 63-bit value has exactly one anchor within the covering radius 1.  Two
fingerprints at most ``bits`` apart have a value between them at most ``ceil(bits / 2)`` from
either, so its anchor lies within radius plus half the threshold of both: sharing the threshold
between the two sides finds the same pairs as radius plus threshold on one side, with 32 copies
of a fingerprint instead of about 650.  An anchor holds at most 4,034 distinct fingerprints
(the ball of radius 2, times two for bit 63), however many documents there are, so no anchor
can grow hot.  Within an anchor fingerprints are compared exactly and a spanning forest of the
links is emitted instead of the links, which keeps every class whole.

Defined results: a null or wordless text has fingerprint zero and links like any other; fewer
than three words form one shingle; repeated rows each give a row; a null id takes part but is
never the id of a component unless the component has no other (then it is null); very long texts
are read whole; an empty table gives no rows; further columns are left out, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from skarn.core.durable import cut
from skarn.operators.components import connected_components

SEED = 42
WORDS = 3
BITS = 2
#: Fingerprints that hold more than one in so many of all rows meet their class by broadcast: never more than HOT_SHARE rows.
HOT_SHARE = 1000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit SimHash of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles: Iterator[bytes] = iter([b" ".join(found)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
        n = len(found) - words + 1
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        ones += np.unpackbits(hashes[k : k + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def _fingerprints(text: pa.Array) -> pa.Array:
    out = np.fromiter((fingerprint(x.as_py()) for x in text), np.uint64, len(text))
    return pa.array(out.view(np.int64))


def anchors(fp: Column) -> Column:
    """Every Hamming anchor within distance 2 of the low 63 bits, as an array."""
    syndrome = F.lit(0)
    for k in range(6):
        mask = sum(1 << (p - 1) for p in range(1, 64) if p >> k & 1)
        syndrome = syndrome + F.shiftleft(F.bit_count(fp.bitwiseAND(F.lit(mask).cast("long"))) % 2, k)
    low = fp.bitwiseAND(F.lit((1 << 63) - 1).cast("long"))
    at = lambda i: F.shiftrightunsigned(F.call_function("shiftleft", F.lit(1).cast("long"), i), 1)  # noqa: E731  no bit for position 0
    pairs = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i < i.bitwiseXOR(syndrome))
    return F.when(syndrome == 0, F.array(low)).otherwise(
        F.transform(pairs, lambda i: low.bitwiseXOR(at(i)).bitwiseXOR(at(i.bitwiseXOR(syndrome))))
    )


def _forest(anchor: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of what is at most ``bits`` apart under one anchor; sorted by anchor."""
    n, lag = len(fp), 1
    label = np.arange(n)
    at = np.flatnonzero(anchor[1:] == anchor[:-1])
    while len(at):
        near = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= bits]
        a, b = near, near + lag
        while len(a):
            la, lb = label[a], label[b]
            keep = la != lb
            a, b, la, lb = a[keep], b[keep], la[keep], lb[keep]
            least = np.minimum(la, lb)
            np.minimum.at(label, la, least)
            np.minimum.at(label, lb, least)
            while not np.array_equal(onward := label[label], label):
                label = onward
        lag += 1
        at = at[at + lag < n]
        at = at[anchor[at] == anchor[at + lag]]
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def _linker(bits: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            anchor, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1]))
            src, dst = _forest(anchor[:end], fp[:end], bits)
            held, rows = [(anchor[end:], fp[end:])], len(anchor) - end
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], ["src", "dst"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            rows += batch.num_rows
            if rows >= 200_000:
                yield from flush(False)
        if rows:
            yield from flush(True)

    return link


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(src, dst) links that join distinct fingerprints (column ``fp``) into their classes."""
    if not 0 <= bits <= 2:
        raise ValueError("radius 1 plus half the threshold is laid out for up to 2 bits")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = fps.select("fp").repartition(parts, F.xxhash64("fp"))  # 32 rows come of each; by fp itself it would be merged with a shuffle before it and coalesced
    dealt = spread.select(F.explode(anchors(F.col("fp"))).alias("anchor"), "fp").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_linker(bits), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, fp, component) for every row; component is the least id reachable over links."""
    fps = cut(docs.select(F.col(id_col).alias("id"), _fingerprints(F.col(text_col)).alias("fp")))
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")))
    classes = connected_components(links(distinct, bits))
    named = cut(
        distinct.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("root"))
    )
    least = cut(named.groupBy("root").agg(F.min("least").alias("component")))
    final = cut(named.join(least, "root").select("fp", "copies", "component"))
    rows = final.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    common = F.col("copies") * HOT_SHARE > rows  # so at most HOT_SHARE fingerprints
    hot = final.where(common).select("fp", F.struct("component").alias("of_hot"))
    marked = fps.join(F.broadcast(hot), "fp", "left")
    rest = marked.where("of_hot is null").select("id", "fp").join(final.where(~common).select("fp", "component"), "fp")
    return marked.where("of_hot is not null").select("id", "fp", F.col("of_hot.component").alias("component")).unionByName(rest.select("id", "fp", "component"))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
