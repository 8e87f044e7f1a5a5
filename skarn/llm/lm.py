"""LM scoring with a probabilistic suffix tree over words.

The root predicts with add-one counts.  A deeper state is one or two preceding words; it is
retained if its words are frequent enough and some next word's probability diverges from what
the next shorter state says (a log-likelihood test), and only diverging next words are listed.
A listed word gets its smoothed share, every other word the state's remaining mass times the
shorter state's probability, so each state's distribution sums to one.  A text's score walks
its words, each predicted by the longest retained state that ends there.

All counts are distributed sums over all training texts.  A state must occur LEAST_STATE times
and a listed word LEAST_ENTRY times after it, at any size of the corpus, so the tree grows with
its input.  Gains add up over the n-grams of a text: a state adds the mass that it leaves, a
listed word what it has above that, and each is one value under the n-gram's code.  Values stay
distributed and are looked up by code; only those of the most frequent words and of n-grams with
ENTRY_SHARE of all training tokens or more, at most 1/ENTRY_SHARE of each kind, are broadcast
instead.  That moves numbers and never changes a result.  Filters of a fixed number of bits keep
n-grams out of the shuffle that can't be in a table; they have no false negatives.

Shuffles of n-grams move packed blocks (skarn/llm/packed.py): sorted codes are sent as differences,
words that are broadcast as their numbers, with one row per block and part of the codes, and parts
in proportion to the training tokens.  Tables between steps are discarded when read for the last time.

Defined results: a null or wordless text is one end token; a null id counts as training;
repeated rows each learn and each give a row; without training rows N and V are 0.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.core.durable import cut, cut_to, discard, sweep
from skarn.core.packed import pack, part_of, runs, summed, unpack
from skarn.llm.tokens import _mixed, word_hashes

#: Share of all training tokens from which a value is broadcast and not looked up; 1/ENTRY_SHARE words are.
ENTRY_SHARE = 1e-6
LEAST_STATE = 8
LEAST_ENTRY = 3
#: Pseudo-count of a state's shorter state.
BACKOFF = 2.0
END = np.uint64(0x656E645F6F665F74)
#: Tokens counted together, codes packed together before they are handed on.
COUNT_BLOCK = 1 << 21
#: Bits of a filter, and of each of the parts that it is put together from.
FILTER = 1 << 25
FILTER_PART = 1 << 19
#: Tokens of training texts for each part that n-grams are dealt to.
PART_TOKENS = 1 << 21


def held_out(row_id: Column) -> Column:
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def with_ends(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes with an end token after each text, and the new bounds."""
    docs = len(bounds) - 1
    moved = bounds + np.arange(docs + 1)
    out = np.empty(len(hashes) + docs, np.uint64)
    ends = moved[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = hashes[bounds[0] : bounds[-1]]
    out[ends] = END
    return out, moved


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The code of a followed by b: of two words a pair, of two overlapping pairs three words."""
    return _mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


@F.arrow_udf(T.LongType())
def _joined(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(joined(*(x.to_numpy().astype(np.int64).view(np.uint64) for x in (a, b))).view(np.int64))


def _sums(text: DataFrame, grams, width: int, out, least: int, parts: int, share: np.ndarray | None = None) -> DataFrame:
    """(columns of ``out``, n) of what occurs ``least`` times or more in all texts.

    grams: (words with ends, their numbers in ``share`` or -1, bounds) -> places of the first of ``width`` words.
    out: names of columns -> their values of the columns of words.

    Blocks of n-grams are added up and dealt out packed. An n-gram of words of ``share`` is one key of their numbers,
    scrambled one to one; of others the words are sent, those of ``share`` as numbers. Without ``share`` words are keys.
    """
    bits = 64 if share is None else max(1, (len(share) - 1).bit_length()) if len(share) else 1
    if share is not None and width * bits > 62:
        share, bits = np.zeros(0, np.uint64), 1
    size = bits * width
    mask = np.uint64((1 << size) - 1)
    odd = np.uint64(1 if share is None else 0x9E3779B97F4A7C15) & mask
    back = np.uint64(pow(int(odd), -1, 1 << size))
    held = text.sparkSession.sparkContext.broadcast(share)
    code = lambda words: functools.reduce(joined, words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = held.value
        keys: list[np.ndarray] = []
        rest: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            found = np.sort(np.concatenate(keys))
            start = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
            n, found = np.diff(np.append(start, len(found))), found[start]
            rows += [(p, True, pack(found[i:j], n[i:j])) for p, i, j in runs(part_of(found, parts, size))]
            if rest:
                columns = [np.concatenate(x) for x in zip(*rest, strict=True)]
                found, first, n = np.unique(code(columns[:width]), return_index=True, return_counts=True)
                columns = [x[first] for x in columns]
                which = sum((x >= 0).astype(np.int64) << k for k, x in enumerate(columns[width:]))
                sent = [np.where(x >= 0, x.view(np.uint64), w) for w, x in zip(columns[:width], columns[width:], strict=True)]
                rows += [(p, False, pack(*(x[i:j] for x in (*sent, which, n)), ordered=False)) for p, i, j in runs(part_of(found, parts))]
            part, dense, data = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(dense, pa.bool_()), pa.array(data, pa.binary())], ["part", "dense", "data"])

        held_n = 0
        for batch in batches:
            for _, _, h, b in word_hashes(batch.column(0)):
                words, bounds = with_ends(h, b)
                if share is None:
                    keys.append(words)
                    held_n += len(words)
                else:
                    number = find(share, words)
                    at = grams(words, number, bounds)
                    ids = [number[at + k] for k in range(width)]
                    known = np.logical_and.reduce([x >= 0 for x in ids])
                    key = np.zeros(int(known.sum()), np.uint64)
                    for x in ids:
                        key = key << np.uint64(bits) | x[known].view(np.uint64)
                    keys.append(key * odd & mask)
                    other = ~known
                    rest.append([*(words[at[other] + k] for k in range(width)), *(x[other] for x in ids)])
                    held_n += len(at)
                if held_n >= COUNT_BLOCK:
                    yield from flush()
                    keys, rest, held_n = [], [], 0
        if held_n:
            yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = held.value
        dense, other = [], []
        for batch in batches:
            for is_dense, data in zip(batch.column("dense").to_pylist(), batch.column("data").to_pylist(), strict=True):
                (dense if is_dense else other).append(unpack(data))
        found = []
        if dense:
            key, n = summed(*(np.concatenate(x) for x in zip(*dense, strict=True)))
            key, n = key[n >= least], n[n >= least]
            if share is None:
                found.append(([key], n))
            else:
                key = key * back & mask
                last = np.uint64((1 << bits) - 1)
                found.append(([share[(key >> np.uint64(bits * (width - 1 - k)) & last).astype(np.int64)] for k in range(width)], n))
        if other:
            *words, which, n = (np.concatenate(x) for x in zip(*other, strict=True))
            for k in range(width):
                known = np.flatnonzero(which >> np.uint64(k) & np.uint64(1))
                words[k][known] = share[words[k][known].astype(np.int64)]
            _, first, same = np.unique(code(words), return_index=True, return_inverse=True)
            n = np.bincount(same, n.astype(np.float64)).astype(np.int64)
            ok = n >= least
            found.append(([x[first[ok]] for x in words], n[ok]))
        for words, n in found:
            columns = [f(*words).view(np.int64) for f in out.values()]
            for k in range(0, len(n), 1 << 16):
                yield pa.RecordBatch.from_arrays([*(pa.array(x[k : k + (1 << 16)]) for x in columns), pa.array(n[k : k + (1 << 16)].astype(np.int64))], [*out, "n"])

    dealt = text.mapInArrow(count, "part int, dense boolean, data binary").repartitionById(parts, "part")
    return dealt.mapInArrow(gather, ", ".join(f"{c} long" for c in (*out, "n")))


def _places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a filter that stand for a code."""
    return codes & np.uint64(FILTER - 1), codes >> np.uint64(32) & np.uint64(FILTER - 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of many batches together, so that what is packed is long."""
    held, size = [], 0
    for batch in batches:
        held.append([x.to_numpy() for x in batch.columns])
        size += batch.num_rows
        if size >= COUNT_BLOCK:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def bloom(table: DataFrame) -> np.ndarray:
    """A Bloom filter of column ``code``, FILTER bits whatever the size of the table; empty for an empty table."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in _blocks(batches):
            at = np.unique(np.concatenate(_places(codes[0].view(np.uint64))))
            rows = [(p, pack(at[i:j] - np.uint64(p * FILTER_PART))) for p, i, j in runs((at // np.uint64(FILTER_PART)).astype(np.int64))]
            part, data = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits.setdefault(part, np.zeros(FILTER_PART, bool))[unpack(data)[0].astype(np.int64)] = True
        for k in sorted(bits):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits[k], bitorder="little").tobytes()])], ["part", "bits"])

    found = table.select("code").mapInArrow(spread, "part int, data binary").repartition("part").mapInArrow(gather, "part int, bits binary").collect()
    if not found:
        return np.zeros(0, np.uint8)
    out = np.zeros((FILTER // FILTER_PART, FILTER_PART // 8), np.uint8)
    for r in found:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def maybe(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which codes may be in the filtered table."""
    if not len(bits):
        return np.zeros(len(codes), bool)
    one, two = _places(codes)
    hit = (bits[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    at = np.flatnonzero(hit)
    two = two[at]
    hit[at] = bits[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8) & 1
    return hit


def _bounded(table: DataFrame, least: float) -> list[np.ndarray]:
    """Columns of what has n of at least ``least``, a share of all tokens: a bounded number. The first, codes, is sorted and unsigned."""
    found = table.where(F.col("n") >= F.lit(float(least))).toArrow()
    columns = [found.column(k).to_numpy() for k in range(found.num_columns)]
    columns[0] = columns[0].astype(np.int64).view(np.uint64)
    order = np.argsort(columns[0])
    return [x[order] for x in columns]


def find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions of values in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)


@dataclass
class Level:
    """Broadcast states of one length, and their broadcast next words."""

    states: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # numbers of the state's symbols, one after the other in the radix
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # of the states, sorted
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 of the mass left to the shorter state
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # codes of state and next word, sorted
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 of probability over what the state leaves to the word


@dataclass
class Tree:
    """total and distinct training tokens, most frequent words (hash, count), and of the deeper levels what is broadcast."""

    total: int
    distinct: int
    words: np.ndarray
    counts: np.ndarray
    levels: list[Level]
    others: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))  # filter of the codes of values that are looked up

    @property
    def symbols(self) -> np.ndarray:
        return self.words

    @property
    def radix(self) -> int:
        return len(self.symbols)

    @property
    def parts(self) -> int:
        return self.total // PART_TOKENS + 1

    def gains(self, words: np.ndarray, bounds: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """log10 of each word's probability over the root's, as far as the broadcast values say."""
        gain = np.zeros(len(words))
        last = np.zeros(len(words), bool)
        last[bounds[1:] - 1] = True
        for length, (at, code) in enumerate(grams or ngrams(words, bounds), 1):
            if length > 1 and length - 2 < len(self.levels):  # the last word is listed
                level = self.levels[length - 2]
                hit = find(level.entries, code)
                gain[at[hit >= 0]] += level.gain[hit[hit >= 0]]
            if length - 1 < len(self.levels):  # a word follows the state
                level = self.levels[length - 1]
                hit = find(level.codes, code)
                hit[last[at]] = -1
                gain[at[hit >= 0] + 1] += level.rest[hit[hit >= 0]]
        return gain


def ngrams(words: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of the last word, and codes, of all runs of one, two and three words of a text."""
    at = np.arange(len(words))
    ahead = at - np.repeat(bounds[:-1], np.diff(bounds))
    two, three = np.flatnonzero(ahead >= 1), np.flatnonzero(ahead >= 2)
    pair = np.zeros(len(words), np.uint64)
    pair[two] = joined(words[two - 1], words[two])
    return [(at, words), (two, pair[two]), (three, joined(pair[three - 1], pair[three]))]


def _most(counts: DataFrame, total: int) -> float:
    """From what count on words are broadcast: as low as leaves 1/ENTRY_SHARE of them, and a share of all tokens at most."""
    share = total * ENTRY_SHARE
    steps = sorted({share, *(float(m << k) for k in range(40) for m in (2, 3) if m << k < share)})
    found = counts.agg(*(F.count(F.when(F.col("n") >= x, 1)) for x in steps)).first()
    return next(x for x, n in zip(steps, found, strict=True) if n <= 1 / ENTRY_SHARE or x == share)


def _diverging(counted: DataFrame, state: str, total: int) -> tuple[DataFrame, DataFrame, str]:
    """Rows (state, n, state_n, parent, ...) with whether they are listed; (state, n, rest) of states that list some; the rows' folder.

    parent: probability of the next word after the shorter state.
    """
    diverges = F.col("n") * F.log(F.col("n") / F.col("state_n") / F.col("parent")) > float(np.log(max(total, 2)))  # by more than a listed word costs
    rows, path = cut_to(counted.withColumn("listed", (F.col("state_n") >= LEAST_STATE) & diverges))
    left = F.greatest(F.max("state_n") - F.sum("n"), F.lit(0))
    states = rows.where("listed").groupBy(state).agg(((left + BACKOFF) / (F.max("state_n") + BACKOFF)).alias("rest"), F.max("state_n").alias("total"))
    return rows, cut(states.select(state, F.col("total").alias("n"), "rest")), path


def train(docs: DataFrame, text_col: str = "text") -> tuple[Tree, DataFrame]:
    """The tree, and (code, n, gain): counts of every training token, and values that are not broadcast."""
    text = docs.select(F.col(text_col).alias("text"))
    spark = docs.sparkSession
    counts = cut(_sums(text, None, 1, {"code": lambda a: a}, 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    total, distinct = int(row["total"]), int(row["distinct"])
    least = max(LEAST_ENTRY, total * ENTRY_SHARE)
    most = _most(counts, total)
    words, n = _bounded(counts, most)
    tree = Tree(total, distinct, words, n.astype(np.float64), [])
    tokens = counts.withColumn("gain", F.lit(0.0))
    frequent = counts.where(F.col("n") >= LEAST_ENTRY)
    held = spark.sparkContext.broadcast((bloom(counts.where(F.col("n") >= LEAST_STATE)), bloom(frequent), n >= LEAST_STATE, n >= LEAST_ENTRY))

    def passes(bits: np.ndarray, ok: np.ndarray, words: np.ndarray, number: np.ndarray) -> np.ndarray:
        known = number >= 0
        out = np.empty(len(words), bool)
        out[known] = ok[number[known]]
        out[~known] = maybe(bits, words[~known])
        return out

    def pairs(words: np.ndarray, number: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of a word that may be a state (so is the last word of any longer state) and one that may be listed."""
        of_state, of_next, state, entry = held.value
        ok = passes(of_state, state, words[:-1], number[:-1])
        ok &= passes(of_next, entry, words[1:], number[1:])
        ok[bounds[1:-1] - 1] = False
        return np.flatnonzero(ok)

    two = _sums(text, pairs, 2, {"a": lambda a, b: a, "b": lambda a, b: b}, LEAST_ENTRY, tree.parts, words)
    root = ((F.col("n") + 1) / float(total + distinct + 1)).alias("parent")
    of_state = frequent.select(F.col("code").alias("a"), F.col("n").alias("state_n"))
    rows, states, path = _diverging(two.join(of_state, "a").join(frequent.select(F.col("code").alias("b"), root), "b"), "a", total)
    share = F.col("n") / (F.col("state_n") + BACKOFF)  # what a listed word has of its state
    rest = F.coalesce("rest", F.lit(1.0)) * F.col("parent")
    after = F.when(F.col("listed"), share + rest).otherwise(rest)
    two, of_two = cut_to(
        rows.join(states.select("a", "rest"), "a", "left").select(
            _joined("a", "b").alias("code"), "n", "a", "b", "listed", after.alias("after"), F.log10(after / rest).alias("gain")
        )
    )
    discard(spark, path)
    values = [states.select(F.col("a").alias("code"), "n", F.log10("rest").alias("gain")), cut(two.where("listed").select("code", "n", "gain"))]
    code, _, gain = _bounded(values[0], most)  # with every broadcast word: it is not asked for
    entry, _, more = _bounded(values[1], least)
    tree.levels.append(Level(find(words, code).astype(np.uint64), code, gain, entry, more))

    held2 = spark.sparkContext.broadcast((bloom(two.where(F.col("n") >= LEAST_STATE)), bloom(two)))

    def triples(words: np.ndarray, number: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        of_state, of_next = held2.value
        at, code = ngrams(words, bounds)[1]
        near = np.flatnonzero(at[1:] == at[:-1] + 1)  # pairs that overlap in one text
        near = near[maybe(of_state, code[near])]
        near = near[maybe(of_next, code[near + 1])]
        return at[near] - 1

    three = _sums(text, triples, 3, {"s": lambda a, b, c: joined(a, b), "t": lambda a, b, c: joined(b, c)}, LEAST_ENTRY, tree.parts, words)
    sweep(spark)
    of_state = two.where(F.col("n") >= LEAST_STATE).select(F.col("code").alias("s"), F.col("n").alias("state_n"))
    of_next = two.select(F.col("code").alias("t"), F.col("after").alias("parent"))
    rows, states, path = _diverging(three.join(of_state, "s").join(of_next, "t"), "s", total)
    rest = F.col("rest") * F.col("parent")
    listed = rows.where("listed").join(states.select("s", "rest"), "s")
    values += [
        states.select(F.col("s").alias("code"), "n", F.log10("rest").alias("gain")),
        cut(listed.select(_joined("s", "t").alias("code"), "n", F.log10((share + rest) / rest).alias("gain"))),
    ]
    named = states.where(F.col("n") >= F.lit(float(least))).join(two.select(F.col("code").alias("s"), "a", "b"), "s")
    code, _, gain, a, b = _bounded(named.select("s", "n", F.log10("rest").alias("gain"), "a", "b"), least)
    a, b = (find(words, x.astype(np.int64).view(np.uint64)).astype(np.uint64) for x in (a, b))
    entry, _, more = _bounded(values[3], least)
    tree.levels.append(Level(a * np.uint64(tree.radix) + b, code, gain, entry, more))
    for x in (path, of_two):  # all that is needed of them is in values
        discard(spark, x)
    others = functools.reduce(DataFrame.unionByName, (x.where(F.col("n") < F.lit(float(most if k == 0 else least))) for k, x in enumerate(values)))
    tree.others = bloom(others)
    return tree, tokens.unionByName(others.withColumn("n", F.lit(0).cast("long")))


SCORED = "part int, block long, row long, row_id {id}, held boolean, n_tokens long, n_known long, logs double, gains double, data binary"
NAMES = [x.split()[0] for x in SCORED.split(", ")]
ADDED = ["row_id", "held", "n_tokens", "n_known", "logs", "gains"]


def _rows(schema: pa.Schema, rows: int, **columns: object) -> pa.RecordBatch:
    """Of these columns; what is not given is null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def score(docs: DataFrame, tree: Tree, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, held, n_tokens, n_known, base_score, score for every row.

    A walk over the texts makes a row a text and, of a block of texts, packed codes whose values are not broadcast, for each
    part of the codes. The task of a part looks them up and answers with sums for texts, packed; a last one adds them up.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(tree)
    parts = tree.parts

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        row = TaskContext.get().partitionId() << 40
        block, start, size = TaskContext.get().partitionId() << 20, row, 0
        logs = np.log10(tree.counts + 1)
        asked: list[tuple[np.ndarray, np.ndarray]] = []  # number of the text in its block, code

        def flush() -> Iterator[pa.RecordBatch]:
            doc, code = (np.concatenate(x) for x in zip(*asked, strict=True))
            order = np.argsort(code, kind="stable")  # texts stay in order
            doc, code = doc[order], code[order]
            new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))
            tf = np.diff(np.append(new, len(code)))
            doc, code = doc[new], code[new]
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            ends = np.append(first, len(code))
            code = code[first]
            rows = [(p, pack(code[i:j], np.diff(ends[i : j + 1]), doc[ends[i] : ends[j]], tf[ends[i] : ends[j]])) for p, i, j in runs(part_of(code, parts))]
            part, data = zip(*rows, strict=True)
            yield _rows(schema, len(rows), part=part, block=[block] * len(rows), row=[start] * len(rows), data=data)

        for batch in batches:
            ids, outs = batch.column(0), batch.column(1)
            number = pa.int64()
            types = (pa.int32(), number, number, ids.type, pa.bool_(), number, number, pa.float64(), pa.float64(), pa.binary())
            schema = pa.schema(list(zip(NAMES, types, strict=True)))
            for first, last, h, b in word_hashes(batch.column(2)):
                words, bounds = with_ends(h, b)
                docs = last - first
                doc = np.repeat(np.arange(docs), np.diff(bounds))
                grams = ngrams(words, bounds)
                at = find(tree.words, words)
                known = at >= 0
                rows = row + np.arange(first, last)
                yield _rows(
                    schema,
                    docs,
                    part=(rows % parts).astype(np.int32),
                    block=np.full(docs, block),
                    row=rows,
                    row_id=ids.slice(first, docs),
                    held=outs.slice(first, docs),
                    n_tokens=np.diff(bounds),
                    n_known=np.bincount(doc[known], minlength=docs),
                    logs=np.bincount(doc[known], logs[at[known]], docs),
                    gains=np.bincount(doc, tree.gains(words, bounds, grams), docs),
                )
                doc += row + first - start
                asked.append((doc[~known], words[~known]))
                for at, code in grams[1:]:
                    hit = maybe(tree.others, code)
                    asked.append((doc[at[hit]], code[hit]))
                size += sum(len(x) for x, _ in asked[-3:])
                if size >= COUNT_BLOCK:
                    yield from flush()
                    asked, block, start, size = [], block + 1, row + last, 0
            row += batch.num_rows
        if size:
            yield from flush()

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n, gain in _blocks(batches):
            code = code.view(np.uint64)
            order = np.argsort(code)
            code, n, gain = code[order], n[order], gain[order]
            rows = [(p, pack(code[i:j], n[i:j], gain[i:j])) for p, i, j in runs(part_of(code, parts))]
            part, data = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[list[np.ndarray]] = []
        asked: list[tuple] = []  # packed until all of the table is here
        for batch in batches:
            packed = batch.column("data").is_valid()
            yield batch.filter(pc.invert(packed))
            for part, block, start, data in zip(*(batch.filter(packed).column(c).to_pylist() for c in ("part", "block", "row", "data")), strict=True):
                if block is None:
                    table.append(unpack(data))
                else:
                    asked.append((part, block, start, data))
        if not table:
            return
        code, n, gain = (np.concatenate(x) for x in zip(*table, strict=True))
        code, n, gain = summed(code, n.view(np.int64), gain.view(np.float64))  # a word has a row for its count and one for its gain
        logs = np.log10(n + 1.0)
        for part, block, start, data in asked:
            codes, times, doc, tf = unpack(data)
            at = np.repeat(find(code, codes), times.astype(np.int64))
            hit = at >= 0
            at, tf = at[hit], tf[hit].astype(np.float64)
            doc, same = np.unique(doc[hit], return_inverse=True)
            if len(doc):
                sums = [np.bincount(same, tf * x) for x in (n[at] > 0, logs[at], gain[at])]
                answer = pack(doc, sums[0].astype(np.int64), sums[1], sums[2])
                yield _rows(batch.schema, 1, part=[part], block=[block], row=[start], data=[answer])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, answers = [], []
        for batch in batches:
            packed = batch.column("data").is_valid()
            texts.append(batch.filter(pc.invert(packed)))
            answers += zip(*(batch.filter(packed).column(c).to_pylist() for c in ("block", "part", "row", "data")), strict=True)
        if not texts:
            return
        found = pa.Table.from_batches(texts).combine_chunks()
        row = found.column("row").to_numpy()
        order = np.argsort(row)
        sums = [found.column(c).to_numpy().copy() for c in ("n_known", "logs", "gains")]
        for _, _, start, data in sorted(answers, key=lambda x: x[:2]):  # in an order of their own, so that reruns agree
            doc, *more = unpack(data)
            at = order[np.searchsorted(row, doc.astype(np.int64) + start, sorter=order)]
            for own, x in zip(sums, more, strict=True):
                own[at] += x.view(own.dtype)
        out = pa.table([*(found.column(c) for c in ("row_id", "held", "n_tokens")), *map(pa.array, sums)], names=ADDED)
        yield from out.to_batches(1 << 16)

    source = docs.select(F.col(id_col).alias("row_id"), held_out(F.col(id_col)).alias("held"), F.col(text_col).alias("text"))
    kind = source.schema["row_id"].dataType.simpleString()
    walked = source.mapInArrow(walk, SCORED.format(id=kind))
    offered = table.select("code", "n", "gain").mapInArrow(offer, "part int, data binary")
    both = walked.unionByName(offered, allowMissingColumns=True).select(*NAMES).repartitionById(parts, "part")
    answered = both.mapInArrow(look, SCORED.format(id=kind)).repartition("block")
    sums = answered.mapInArrow(add, f"row_id {kind}, held boolean, n_tokens long, n_known long, logs double, gains double")
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(tree.total + tree.distinct + 1)))
    return sums.select("row_id", "held", "n_tokens", "n_known", base.alias("base_score"), (base + F.col("gains")).alias("score"))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Tree]:
    """Train on the rows that are not held out, then score all rows."""
    tree, table = train(docs.where(~held_out(F.col(id_col))), text_col)
    sweep(docs.sparkSession)
    return score(docs, tree, table, id_col, text_col), tree
