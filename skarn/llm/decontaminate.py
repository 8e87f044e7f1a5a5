"""Benchmark decontamination by latent semantic retrieval.

Passages are runs of BLOCK words; a window is two neighbouring blocks.  One distributed pass
over all texts gives passage frequencies of hashed terms and the sketch TF'TF W of a random
W; with the inverse frequencies D that is a sketch of the Gram matrix of all TF-IDF passages,
from which a Nystroem step takes its leading singular vectors and values on the driver (a fixed
number of hashed terms times DIMS).  A second pass projects every window of every text and
every window of the benchmark into that space, scaled by the singular values.  Candidates are
pairs with cosine LATENT or more, whatever words they share; pairs with cosine NEAR that share
SHARED of the words; and, since foreign words turn the direction of a window around a short item,
pairs that share VERBATIM of the words (SHARED for an item shorter than a window).  Windows of a
text begin every BLOCK words, so of a verbatim copy some window holds three quarters of min(item,
window) words: none is lost.  Candidates are verified on the words themselves.

A document leaks an item if the longest common subsequence of item and neighbourhood holds
COPIED of the item's words, or PARAPHRASED of them and the item's answer (its last sentence)
to the share ANSWERED as well.  Words are lower-cased runs of letters and digits.  An item of
fewer than MIN_ITEM words has no direction of its own: it is searched as a run of its words.

The benchmark is the stated query set.  It is worked off in blocks of at most ITEM_BLOCK items,
each broadcast as word positions and vectors (some 20 MB); texts are never shuffled and nothing
about documents reaches the driver but the sketch, which is added up in a tree.

Defined results: a null or wordless text leaks nothing; an item without a word is not searched;
repeated rows each give a row; equal items are both reported; an empty benchmark leaks nothing, an
empty table gives no rows; texts of any length are searched whole; a column ``leaks`` of the input
is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skarn.llm.lm import joined
from skarn.llm.tokens import NOT_ALNUM, word_hashes

TERMS = 1 << 14
DIMS = 32
BLOCK = 16
NEAR = 0.35
#: Cosine that makes a candidate whatever words are shared.
LATENT = 0.8
#: Least share of an item window's words among the candidate's, a bound on any common subsequence.
SHARED = 0.5
#: The share that makes a candidate whatever the cosine.
VERBATIM = 0.75
COPIED = 0.8
PARAPHRASED = 0.6
ANSWERED = 0.75
#: Items with fewer words are searched as runs of words.
MIN_ITEM = 8
ITEM_BLOCK = 20_000
#: Items that are compared with all windows of a run of texts at once.
ITEM_STEP = 256
SKETCH_ROWS = 128
#: Binary logarithm of how many partial sketches one task adds up.
FAN = 10
SEED = 11


def random_matrix() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((TERMS, DIMS)).astype(np.float32)


def _words(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of lower-cased runs of letters and digits, and bounds of the texts."""
    for _, _, h, bounds in word_hashes(pc.utf8_lower(text), NOT_ALNUM):
        yield h, bounds


def _blocks(bounds: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First word of each block, and the text of each block; blocks don't cross texts, the last of a text may be short."""
    lengths = np.diff(bounds)
    count = -(-lengths // size)
    doc = np.repeat(np.arange(len(lengths)), count)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return bounds[doc] + within * size, doc


def _summed_rows(table: np.ndarray, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Sums of the table's rows of each block's words; blocks hold up to ``size`` words."""
    out = np.zeros((len(starts), table.shape[1]), table.dtype)
    for k in range(size):
        live = np.flatnonzero(starts + k < ends)
        if len(live) == len(starts):
            out += table[ids[starts + k]]
        else:
            out[live] += table[ids[starts[live] + k]]
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of TF'TF W and of passage frequencies, summed over the task's texts."""
    w = random_matrix()
    product = np.zeros((DIMS, TERMS))
    frequency = np.zeros(TERMS, np.int64)
    passages = 0
    for batch in batches:
        for h, bounds in _words(batch.column(0)):
            if not len(h):
                continue
            term = (h & np.uint64(TERMS - 1)).astype(np.int64)
            starts, _ = _blocks(bounds, 2 * BLOCK)
            passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
            summed = _summed_rows(w, term, starts, np.append(starts[1:], len(h)), 2 * BLOCK)
            for d in range(DIMS):
                product[d] += np.bincount(term, summed[:, d][passage], TERMS)
            frequency += np.bincount(np.unique(passage * TERMS + term) % TERMS, minlength=TERMS)
            passages += len(starts)
    step = TERMS // SKETCH_ROWS
    leaf = TaskContext.get().partitionId()
    parts = [(k, leaf, product[:, k * step : (k + 1) * step].astype(np.float32).tobytes(), frequency[k * step : (k + 1) * step].tobytes(), passages) for k in range(SKETCH_ROWS)]
    yield pa.RecordBatch.from_pylist([dict(zip(_SKETCH_SCHEMA.names, p, strict=True)) for p in parts], schema=_SKETCH_SCHEMA)


_SKETCH_SCHEMA = pa.schema([("part", pa.int32()), ("leaf", pa.int32()), ("product", pa.binary()), ("frequency", pa.binary()), ("passages", pa.int64())])
_SKETCH = "part int, leaf int, product binary, frequency binary, passages long"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows with the same part and leaf, which come one after the other; one sum is held at a time."""
    at, sums = None, None

    def row() -> pa.RecordBatch:
        product, frequency, passages = sums
        values = (*at, product.astype(np.float32).tobytes(), frequency.tobytes(), passages)
        return pa.RecordBatch.from_pylist([dict(zip(_SKETCH_SCHEMA.names, values, strict=True))], schema=_SKETCH_SCHEMA)

    for batch in batches:
        for part, leaf, product, frequency, passages in zip(*batch.columns, strict=True):
            here = (part.as_py(), leaf.as_py())
            more = np.frombuffer(product.as_buffer(), np.float32).astype(np.float64), np.frombuffer(frequency.as_buffer(), np.int64).copy(), passages.as_py()
            if here == at:
                sums = tuple(x + y for x, y in zip(sums, more, strict=True))
            else:
                if at is not None:
                    yield row()
                at, sums = here, more
    if at is not None:
        yield row()


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """TERMS x DIMS: a term's coordinates in the latent space, its inverse passage frequency included."""
    sketch = docs.select(F.col(text_col).alias("text")).mapInArrow(_sketch, _SKETCH)
    for _ in range(2):  # leaves are task numbers, so two steps leave one sum of a part for up to 2**20 tasks
        sketch = sketch.withColumn("leaf", F.shiftright("leaf", FAN)).repartition("part", "leaf").sortWithinPartitions("part", "leaf").mapInArrow(_added, _SKETCH)
    product, frequency, passages = np.zeros((TERMS, DIMS)), np.zeros(TERMS), 0
    step = TERMS // SKETCH_ROWS
    for p in sketch.collect():
        at = slice(p.part * step, (p.part + 1) * step)
        product[at] += np.frombuffer(p.product, np.float32).reshape(DIMS, step).T
        frequency[at] += np.frombuffer(p.frequency, np.int64)
        passages += p.passages if p.part == 0 else 0
    idf = np.where(frequency > 0, np.log((passages + 1) / np.maximum(frequency, 1)), 0.0)
    y = idf[:, None] * product  # the Gram matrix of TF-IDF passages times W / idf
    core = random_matrix().astype(np.float64).T @ product
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    good = values > values.max(initial=0) * 1e-7
    if not good.any():
        return np.zeros((TERMS, DIMS), np.float32)
    u, s, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    out = np.zeros((TERMS, DIMS), np.float32)
    out[:, : len(s)] = idf[:, None] * u / np.maximum(s, s.max(initial=0) * 1e-7 + 1e-30)
    return out


@dataclass
class Items:
    """A block of benchmark items in the latent space."""

    ids: list
    words: list[np.ndarray]  # as positions in the vocabulary
    answers: list[np.ndarray]
    vectors: np.ndarray  # windows x DIMS, of length one
    owner: np.ndarray  # item of each window
    need: np.ndarray  # words that a window must share
    enough: np.ndarray  # words that make it a candidate whatever the cosine
    vocabulary: np.ndarray  # sorted hashes of all words of items
    short: dict[int, tuple[np.ndarray, list]]  # by number of words: codes of short items, sorted, and their ids
    masks: dict[int, dict[int, int]] = field(default_factory=dict)  # where each word of an item stands in it, as bits; of items met so far

    def mask(self, number: int) -> dict[int, int]:
        if number not in self.masks:
            self.masks[number] = positions(self.words[number])
        return self.masks[number]

    def held(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Of ITEM_STEP items: the row of each word of the vocabulary, and rows x items; the last row is for other words."""
        own = self.words[first : first + ITEM_STEP]
        used, rows = np.unique(np.concatenate(own), return_inverse=True)
        row = np.full(len(self.vocabulary) + 1, len(used))
        row[used] = np.arange(len(used))
        has = np.zeros((len(used) + 1, len(own)), np.uint8)
        has[rows, np.repeat(np.arange(len(own)), list(map(len, own)))] = 1
        return row, has


def _windows(words: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and unit vectors of a text's windows of two blocks."""
    starts = np.arange(0, max(1, len(words) - BLOCK), BLOCK)
    term = (words & np.uint64(TERMS - 1)).astype(np.int64)
    z = np.stack([table[term[s : s + 2 * BLOCK]].sum(0) for s in starts])
    return starts, z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def _text_words(text: str | None) -> np.ndarray:
    return next(_words(pa.array([text or ""])))[0]


def _run_codes(words: np.ndarray, n: int) -> np.ndarray:
    """A code for every run of n words."""
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = joined(out, words[k : len(words) - n + 1 + k])
    return out


def prepare(items: list[tuple[object, str | None]], table: np.ndarray) -> Items:
    ids, words, answers, vectors, owner, need, enough = [], [], [], [], [], [], []
    brief: dict[int, list] = {}
    for item, text in items:
        own = _text_words(text)
        if len(own) < MIN_ITEM:
            if len(own):
                brief.setdefault(len(own), []).append((int(_run_codes(own, len(own))[0]), item))
            continue
        sentences = [s for s in (text or "").replace("\n", ". ").split(". ") if len(_text_words(s)) >= 3]
        starts, z = _windows(own, table)
        owner += [len(ids)] * len(starts)
        need += [SHARED * min(2 * BLOCK, len(own)) for _ in starts]
        enough += [(VERBATIM if len(own) >= 2 * BLOCK else SHARED) * min(2 * BLOCK, len(own)) for _ in starts]
        vectors.append(z)
        ids.append(item)
        words.append(own)
        answers.append(_text_words(sentences[-1]) if sentences else own)
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    words = [np.searchsorted(vocabulary, own) for own in words]
    answers = [np.searchsorted(vocabulary, own) for own in answers]
    z = np.concatenate(vectors).astype(np.float32) if vectors else np.zeros((0, DIMS), np.float32)
    short = {}
    for n, found in brief.items():
        found.sort(key=lambda x: x[0])
        short[n] = np.array([c for c, _ in found], np.uint64), [item for _, item in found]
    return Items(ids, words, answers, z, np.array(owner, np.int64), np.array(need), np.array(enough), vocabulary, short)


def positions(words: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    return masks


def common(masks: dict[int, int], length: int, words: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the text that ``masks`` describes."""
    full = (1 << length) - 1
    row = full
    for w in words.tolist():
        if hit := masks.get(w, 0):
            both = row & hit
            row = (row + both | row - both) & full
    return length - row.bit_count()


def verify(items: Items, number: int, text: np.ndarray) -> float:
    """The share of the item that the text holds, negative if that is no leak."""
    length = len(items.words[number])
    share = common(items.mask(number), length, text) / length
    if share >= COPIED:
        return share
    answer = items.answers[number]
    if share >= PARAPHRASED and common(positions(answer), len(answer), text) >= ANSWERED * len(answer):
        return share
    return -share


def _short(words: np.ndarray, bounds: np.ndarray, items: Items) -> Iterator[tuple[int, object]]:
    """(text, item id) of short items that stand in a text as a run."""
    for n, (codes, ids) in items.short.items():
        if len(words) < n:
            continue
        runs = _run_codes(words, n)
        at = np.flatnonzero(np.isin(runs, codes))
        doc = np.searchsorted(bounds, at, "right") - 1
        inside = at + n <= bounds[doc + 1]
        for d, code in set(zip(doc[inside].tolist(), runs[at[inside]].tolist(), strict=True)):
            first, last = (int(np.searchsorted(codes, np.uint64(code), side)) for side in ("left", "right"))
            for k in range(first, last):
                yield d, ids[k]


def _search(words: np.ndarray, bounds: np.ndarray, items: Items, table: np.ndarray) -> list[dict[int, float]]:
    """For each text, the numbers of items that it leaks and their shares."""
    out: list[dict[int, float]] = [{} for _ in range(len(bounds) - 1)]
    if not len(words) or not len(items.ids):
        return out
    term = (words & np.uint64(TERMS - 1)).astype(np.int64)
    starts, doc = _blocks(bounds)
    ends = np.append(starts[1:], len(words))
    z = _summed_rows(table, term, starts, ends, BLOCK)
    z[:-1] += np.where((doc[:-1] == doc[1:])[:, None], z[1:], 0)
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    other = len(items.vocabulary)
    known = np.searchsorted(items.vocabulary, words)
    known[known == other] = 0
    known = np.where(items.vocabulary[known] == words, known, other)
    seen = np.zeros(other + 1, bool)
    sizes = np.array(list(map(len, items.words)))
    first_block = np.searchsorted(doc, np.arange(len(bounds)))
    for first in range(0, len(items.ids), ITEM_STEP):
        span = slice(*np.searchsorted(items.owner, (first, first + ITEM_STEP)))
        row, has = items.held(first)
        shared = _summed_rows(has, row[known], starts, ends, BLOCK)
        ahead = np.zeros((len(shared) + 1, shared.shape[1]), np.int32)
        np.cumsum(shared, 0, out=ahead[1:])
        shared[:-1] += np.where((doc[:-1] == doc[1:])[:, None], shared[1:], 0).astype(np.uint8)
        owner = items.owner[span] - first
        both, cosine = shared[:, owner], z @ items.vectors[span].T
        near, at = np.nonzero((cosine >= LATENT) | (both >= items.need[span]) & ((cosine >= NEAR) | (both >= items.enough[span])))
        reach = sizes[first + owner[at]] // BLOCK + 1  # blocks that the neighbourhood has on either side, at most
        low, high = np.maximum(near - reach, first_block[doc[near]]), np.minimum(near + 2 + reach, first_block[doc[near] + 1])
        possible = ahead[high, owner[at]] - ahead[low, owner[at]] >= PARAPHRASED * sizes[first + owner[at]]  # no common subsequence is longer
        near, at = near[possible], at[possible]
        for window, number in sorted(set(zip(near.tolist(), (owner[at] + first).tolist(), strict=True))):
            own, d = items.words[number], int(doc[window])
            text = known[max(bounds[d], starts[window] - len(own)) : min(bounds[d + 1], starts[window] + 2 * BLOCK + len(own))]
            seen[text] = True
            seen[other] = False
            possible = np.count_nonzero(seen[own])  # no common subsequence is longer
            seen[text] = False
            if possible >= PARAPHRASED * len(own):
                share = verify(items, number, text)
                if share > out[d].get(number, 0):
                    out[d][number] = share
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``leaks``: the items leaked, with their shares, by item."""
    spark = docs.sparkSession
    table = fit(docs, text_col)
    blocks = max(1, -(-benchmark.count() // ITEM_BLOCK))
    kind = T.ArrayType(T.StructType([T.StructField("item", benchmark.schema[item_col].dataType), T.StructField("share", T.DoubleType())]))
    found = F.array().cast(kind)
    source = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    for k in range(blocks):
        own = source.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        held = spark.sparkContext.broadcast((prepare([tuple(r) for r in own], table), table))
        found = F.concat(found, _searcher(held, kind)(F.col(text_col)))
    return docs.withColumn("leaks", F.array_sort(found))


def _searcher(held, kind: T.ArrayType):
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def search(text: pa.Array) -> pa.Array:
        items, table = held.value
        out: list[list[dict]] = []
        for h, bounds in _words(text):
            found = [[{"item": items.ids[k], "share": s} for k, s in one.items()] for one in _search(h, bounds, items, table)]
            for d, item in _short(h, bounds, items):
                found[d].append({"item": item, "share": 1.0})
            out += found
        return pa.array(out, arrow)

    return search
