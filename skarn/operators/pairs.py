"""All pairs of words that stand near each other, counted on little disk.

Frequent words get numbers, which are broadcast with their counts; a pair of two of them is a code
of the two numbers.  A task counts the codes of a block of tokens and deals them out, sorted and
packed, so that a shuffled pair takes two or three bytes.  A pair belongs to its rarer word, its
owner: a common word owns no pair with a rarer one, so no part is large.  Words without a number are
written out, once a block and part.  A part adds up its pairs and hands them on as lists, an owner's
pairs a slice, that are exploded by compiled rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.core.durable import cut
from skarn.core.packed import pack, runs, unpack

NUMBERED = 1_000_000  # words that are broadcast at most
BLOCK_TOKENS = 3 << 18  # tokens whose pairs are counted at once
PART_TOKENS = 1 << 19  # tokens of the corpus for each part of the pairs
BITS = 22  # of the number of a word, or of one of a block's other words: NUMBERED + BLOCK_TOKENS + window is less
LIST = 1 << 15  # pairs handed on in one row
ROWS = "own array<struct<a: string, start: int, size: int, c: long>>, near array<struct<b: string, n: long, c: long>>"


def _doc(words: pa.Array) -> np.ndarray:
    """Of every token, the place of its list."""
    return np.repeat(np.arange(len(words), dtype=np.int32), pc.list_value_length(words).to_numpy(zero_copy_only=False))


def _slices(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.Array]:
    """The lists of the first column, in slices of so many tokens, or of one list."""
    for batch in batches:
        words = batch.column(0)
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        k = 0
        while k < len(words):
            end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + tokens, "right")))
            yield words.slice(k, end - k)
            k = end


def pairs_of(words: pa.Array, window: int) -> np.ndarray:
    """How many pairs of different words each list has."""
    doc, word = _doc(words), words.flatten().dictionary_encode().indices.to_numpy()
    out = np.zeros(len(words), np.int64)
    for d in range(1, window + 1):
        out += np.bincount(doc[d:][(doc[d:] == doc[:-d]) & (word[d:] != word[:-d])], minlength=len(words))
    return out


@dataclass
class Words:
    """(term, cf) of a corpus, those that have numbers, and the numbers of tokens and pairs."""

    counts: DataFrame
    terms: pa.Array  # by falling count, then by term
    cf: np.ndarray
    every: bool  # all words have numbers
    tokens: int
    pairs: int

    @property
    def parts(self) -> int:
        return self.tokens // PART_TOKENS + 1


def words_of(lists: DataFrame, window: int) -> Words:
    """One look at the texts; the numbers go to all words of some count and more, at most NUMBERED."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _slices(batches, BLOCK_TOKENS):
            coded = words.flatten().dictionary_encode()
            word, doc = coded.indices.to_numpy(), _doc(words)
            pairs = sum(int(np.count_nonzero((doc[d:] == doc[:-d]) & (word[d:] != word[:-d]))) for d in range(1, window + 1))
            for term, n in ((coded.dictionary, np.bincount(word, minlength=len(coded.dictionary))), (pa.nulls(1, pa.string()), [pairs])):
                yield pa.RecordBatch.from_arrays([term, pa.array(n, pa.int64())], ["term", "n"])

    found = cut(lists.select("words").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("cf")))
    pairs = found.where("term IS NULL").first()
    counts = found.where("term IS NOT NULL")
    sizes = counts.groupBy("cf").agg(F.count(F.lit(1)).alias("words")).toArrow()  # one row a count
    cf, words = (sizes.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    order = np.argsort(-cf)
    fits = np.cumsum(words[order]) <= NUMBERED
    least = int(cf[order][fits][-1]) if fits.any() else int(cf.max(initial=0)) + 1
    known = counts.where(F.col("cf") >= least).toArrow()
    known = known.take(pc.sort_indices(known, sort_keys=[("cf", "descending"), ("term", "ascending")])).combine_chunks()
    terms = pa.array(known.column(0).combine_chunks() if len(known) else [], pa.string())
    return Words(counts, terms, known.column(1).to_numpy().astype(np.int64), bool(fits.all()), int((cf * words).sum()), pairs.cf if pairs else 0)


def _blocks(batches: Iterator[pa.RecordBatch], window: int, tokens: int) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """Tokens, the places of their lists, and how many of them are a block's own; the ``window`` next ones follow."""

    def split(held: list[pa.Array]) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
        lists = pa.concat_arrays(held)
        flat, doc = lists.flatten(), _doc(lists)
        for k in range(0, len(flat), tokens):  # one list may be longer
            yield flat[k : k + tokens + window], doc[k : k + tokens + window], min(tokens, len(flat) - k)

    held, size = [], 0
    for words in _slices(batches, tokens // 8):
        n = len(words.flatten())
        if held and size + n > tokens:
            yield from split(held)
            held, size = [], 0
        held.append(words)
        size += n
    if held:
        yield from split(held)


def dealt(lists: DataFrame, words: Words, window: int) -> DataFrame:
    """(part, data, more, rare): a block's pairs of a part, packed; those of a word without a number are in ``more``.

    An owner with a number is of part number % parts and coded number // parts; one without is of a part by its bytes and
    coded by its place in ``rare``.  ``more`` has how often the block has the words of ``rare`` that are of the part.
    """
    held, parts, size = lists.sparkSession.sparkContext.broadcast(words.terms), words.parts, len(words.terms)
    first = size // parts + 1  # code of the first owner without a number
    low = np.uint64((1 << BITS) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, doc, own in _blocks(batches, window, BLOCK_TOKENS):
            coded = flat.dictionary_encode()
            number = pc.index_in(coded.dictionary, value_set=held.value)
            rare = coded.dictionary.filter(pc.is_null(number))
            rare = rare.take(pc.array_sort_indices(rare))
            home = np.array([crc32(x.encode()) % parts for x in rare.to_pylist()], np.int64)
            there = pc.add(pc.index_in(coded.dictionary, value_set=rare), size)
            ident = pc.coalesce(number, there).to_numpy(zero_copy_only=False).astype(np.int64)
            ranked = np.sort(ident)  # a word's rank in the block follows its number, then its place in rare
            word = np.searchsorted(ranked, ident).astype(np.int32)[coded.indices.to_numpy()]
            known = ranked[: len(ranked) - len(rare)]
            owner = np.concatenate([known % parts << 2 * BITS | known // parts << BITS, home << 2 * BITS | first + np.arange(len(rare)) << BITS])
            keys, at = np.empty(own * window, np.uint64), 0
            for d in range(1, window + 1):
                a, b = word[:-d][:own], word[d:][:own]
                near = np.flatnonzero((doc[d:][:own] == doc[:-d][:own]) & (a != b))
                a, b = a[near], b[near]
                keys[at : at + len(near)] = owner[np.maximum(a, b)] | ranked[np.minimum(a, b)]
                at += len(near)
            keys = keys[:at]
            keys.sort()
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if at else np.zeros(0, np.int64)
            counts, keys = np.diff(np.append(start, at)), keys[start]
            del start, a, b, near
            seen = np.bincount(word[:own], minlength=len(ranked))[len(known) :]
            by_home = np.argsort(home, kind="stable")
            of_part = {p: by_home[i:j] for p, i, j in runs(home[by_home])}
            rows = []
            places = {p: (i, j) for p, i, j in runs((keys >> np.uint64(2 * BITS)).astype(np.int64))}
            for p in sorted(places.keys() | of_part.keys()):
                i, j = places.get(p, (0, 0))
                codes, n = keys[i:j] & np.uint64((1 << 2 * BITS) - 1), counts[i:j]
                cutoff = int(np.searchsorted(codes, np.uint64(first << BITS)))
                more, used = b"", np.zeros(0, np.int64)
                if p in of_part:
                    a, b = (codes[cutoff:] >> np.uint64(BITS)).astype(np.int64) - first, (codes[cutoff:] & low).astype(np.int64)
                    used = np.union1d(of_part[p], b[b >= size] - size)
                    a, b = np.searchsorted(used, a), np.where(b < size, b, size + np.searchsorted(used, b - size))
                    more = pack((a << BITS | b).astype(np.uint64), n[cutoff:], np.where(home[used] == p, seen[used], 0))
                rows.append((p, pack(codes[:cutoff], n[:cutoff]), more, rare.take(pa.array(used))))
            if rows:
                part, data, more, own_rare = zip(*rows, strict=True)
                offsets = np.cumsum([0, *map(len, own_rare)])
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary()), pa.array(more, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(own_rare))], ["part", "data", "more", "rare"])

    return lists.select("words").mapInArrow(deal, "part int, data binary, more binary, rare array<string>").repartitionById(parts, "part")


def _lists(owner: np.ndarray, a: pa.Array, ca: np.ndarray, other: np.ndarray, b: pa.Array, cb: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ROWS: owners, sorted, are places in ``a`` and ``ca``, the others in ``b`` and ``cb``."""
    for k in range(0, len(owner), LIST):
        own, near = owner[k : k + LIST], other[k : k + LIST]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        size = np.diff(np.append(start, len(own)))
        own = own[start]
        left = pa.StructArray.from_arrays([a.take(pa.array(own)), pa.array(start + 1, pa.int32()), pa.array(size, pa.int32()), pa.array(ca[own])], ["a", "start", "size", "c"])
        right = pa.StructArray.from_arrays([b.take(pa.array(near)), pa.array(n[k : k + LIST]), pa.array(cb[near])], ["b", "n", "c"])
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (left, right)], ["own", "near"])


def _together(packs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and their summed counts, of packs whose counts are below 2**31."""
    codes, counts = zip(*((x, n.astype(np.int32)) for x, n in packs), strict=True)
    codes, counts = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    del order
    start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[start], np.add.reduceat(counts, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)


def added(blocks: DataFrame, words: Words, counted: bool | None = None) -> DataFrame:
    """(t1, t2, n, c1, c2): pairs and the counts of their words, in either order.

    ``counted``: only pairs whose counts are known here; if false, only the others, two words without a number each.
    """
    held, parts, size = blocks.sparkSession.sparkContext.broadcast((words.terms, words.cf)), words.parts, len(words.terms)
    first = size // parts + 1

    def numbered(p: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        terms, cf = held.value
        codes, n = _together(map(unpack, data))
        owner, other = (codes >> np.uint64(BITS)).astype(np.int64) * parts + p, (codes & np.uint64((1 << BITS) - 1)).astype(np.int64)
        del codes
        yield from _lists(owner, terms, cf, other, terms, cf, n)

    def others(more: list[bytes], rare: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        terms, cf = held.value
        coded = pa.concat_arrays(rare).dictionary_encode()
        place, own = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        seen, found, at = np.zeros(len(own), np.int64), [], 0
        for data, its in zip(more, rare, strict=True):
            codes, n, times = unpack(data)
            here = place[at : at + len(its)]
            at += len(its)
            seen[here] += times.astype(np.int64)
            a, b = here[(codes >> np.uint64(BITS)).astype(np.int64)], (codes & np.uint64((1 << BITS) - 1)).astype(np.int64)
            b[b >= size] = size + here[b[b >= size] - size]
            found.append(((a << 32 | b).astype(np.uint64), n))
        keys, n = _together(found)
        a, b = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64((1 << 32) - 1)).astype(np.int64)
        one, two = np.flatnonzero(b < size), np.flatnonzero(b >= size)
        if counted is not False:
            yield from _lists(a[one], own, seen, b[one], terms, cf, n[one])
        if counted is not True:
            yield from _lists(a[two], own, seen, b[two] - size, own, seen, n[two])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: dict[int, list[bytes]] = {}
        more: dict[int, list] = {}
        for batch in batches:
            part, packs, extra, rare = (batch.column(k) for k in range(4))
            for k, p in enumerate(part.to_pylist()):
                if counted is not False:
                    data.setdefault(p, []).append(packs[k].as_py())
                if own := extra[k].as_py():
                    more.setdefault(p, []).append((own, rare[k].values))
        for p in sorted(data.keys() | more.keys()):
            if p in data:
                yield from numbered(p, data.pop(p))
            if p in more:
                yield from others(*zip(*more.pop(p), strict=True))

    found = blocks.mapInArrow(add, ROWS).select("near", F.explode("own").alias("o"))
    each = found.select("o.a", F.col("o.c").alias("c1"), F.explode(F.slice("near", F.col("o.start"), F.col("o.size"))).alias("x"))
    return each.select(F.least("a", "x.b").alias("t1"), F.greatest("a", "x.b").alias("t2"), "x.n", "c1", F.col("x.c").alias("c2"))
