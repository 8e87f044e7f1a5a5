"""Corpus statistics, vocabulary and passage vectors.

All inputs are (id, text) rows; every count is a partially aggregated group-by, pairs are made
inside each row, and tables that are joined by term keep one row per term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.core.durable import cut
from skarn.functions import lexicon as L
from skarn.functions import text as X
from skarn.operators import pairs as P

WINDOW = 9  # a token pairs with so many following tokens


def token_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words) of the passages that have words."""
    return docs.select(F.col(id_col).alias("id"), X.tokens(F.col(text_col)).alias("words")).where(F.size("words") > 0)


def token_stats(lists: DataFrame) -> DataFrame:
    """(term, cf, df, last_id): occurrences, passages, and the last passage by id."""
    per_doc = lists.select("id", F.explode("words").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"), F.max("id").alias("last_id"))


def pair_stats(lists: DataFrame, window: int = WINDOW) -> DataFrame:
    """(t1, t2, n) with t1 < t2: how often two terms are at most ``window`` tokens apart."""
    words = P.words_of(lists, window)
    return P.added(P.dealt(lists, words, window), words).select("t1", "t2", "n")


def pair_mass(words: Column, window: int = WINDOW) -> Column:
    """How many pairs of different terms a passage has, as ``pair_stats`` counts them."""
    n = F.size(words)
    apart = lambda d: F.zip_with(F.slice(words, F.lit(1), F.greatest(F.lit(0), n - d)), F.slice(words, F.least(d + 1, n), F.greatest(F.lit(0), n - d)), lambda a, b: a != b)
    return sum((F.size(F.filter(apart(F.lit(d)), lambda x: x)) for d in range(1, window + 1)), F.lit(0)).cast("long")


def pairs_around(lists: DataFrame, terms: list[str], window: int = WINDOW) -> DataFrame:
    """The rows of ``pair_stats`` that have one of ``terms`` on either side; no other pair is made.

    ``terms`` is of a bounded size (a vocabulary).  A pair of two of them is made once.
    A batch's words are numbered, and its pairs counted by numbers before they are rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            flat = words.flatten().dictionary_encode()
            if not len(flat):
                continue
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            word = flat.indices.to_numpy().astype(np.int64)
            size = len(flat.dictionary)
            inside = pc.is_in(flat.dictionary, value_set=pa.array(terms, pa.string())).to_numpy(zero_copy_only=False)[word]
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for d in range(1, window + 1):
                a, b = word[:-d], word[d:]
                at = np.flatnonzero((inside[:-d] | inside[d:]) & (doc[d:] == doc[:-d]) & (a != b))
                found, n = np.unique(np.minimum(a[at], b[at]) * size + np.maximum(a[at], b[at]), return_counts=True)
                keys, place = np.unique(np.concatenate([keys, found]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            a, b = (flat.dictionary.take(pa.array(x)) for x in (keys // size, keys % size))
            for k in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([x[k : k + (1 << 16)] for x in (a, b, pa.array(counts))], ["a", "b", "n"])

    pairs = lists.select("words").mapInArrow(count, "a string, b string, n long")
    return pairs.groupBy(F.least("a", "b").alias("t1"), F.greatest("a", "b").alias("t2")).agg(F.sum("n").alias("n"))


def pairs_among(lists: DataFrame, terms: list[str], wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``pair_stats`` for the pairs (t1, t2) of ``wanted``, whose terms are ``terms``; both of a checked size."""
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: s["w"].isin(terms))
    kept = lists.select(places.alias("at"))
    at, n = F.col("at"), F.size("at")
    step = lambda d: F.zip_with(
        F.slice(at, F.lit(1), F.greatest(F.lit(0), n - d)),
        F.slice(at, F.least(F.lit(d + 1), n), F.greatest(F.lit(0), n - d)),
        lambda a, b: F.when((b["i"] - a["i"] <= window) & (a["w"] != b["w"]), F.struct(F.least(a["w"], b["w"]).alias("t1"), F.greatest(a["w"], b["w"]).alias("t2"))),
    )
    near = F.array_compact(F.flatten(F.array(*(step(d) for d in range(1, window + 1)))))
    pairs = kept.where("size(at) > 1").select(F.explode(near).alias("p")).select("p.t1", "p.t2")
    return pairs.join(F.broadcast(wanted), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"))


def corpus_stats(lists: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row: doc_count, token_mass and, with pairs, pair_mass."""
    one = lists.agg(F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("token_mass"))
    return one if pairs is None else one.crossJoin(pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pair_mass")))


def learned_totals(lists: DataFrame) -> DataFrame:
    """One row: doc_count, token_mass and pair_mass; pairs are compared by numbers of words and not made."""

    def mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (len(words), len(words.flatten()), int(P.pairs_of(words, WINDOW).sum()))], ["docs", "tokens", "pairs"])

    found = lists.select("words").mapInArrow(mass, "docs long, tokens long, pairs long")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return found.agg(total("docs", "doc_count"), total("tokens", "token_mass"), total("pairs", "pair_mass"))


def pmi(pairs: DataFrame, stats: DataFrame, totals: DataFrame) -> DataFrame:
    """(t1, t2, n, pmi): log2 of joint over product, each with its own mass."""
    c1, c2 = (stats.select(F.col("term").alias(t), F.col("cf").alias(c)) for t, c in (("t1", "c1"), ("t2", "c2")))
    joined = pairs.join(c1, "t1").join(c2, "t2").crossJoin(F.broadcast(totals))  # one row
    return joined.select("t1", "t2", "n", _pmi(F.col("token_mass"), F.col("pair_mass")).alias("pmi"))


def _pmi(mass: Column, pair_mass: Column) -> Column:
    return F.log2((F.col("n") / pair_mass) / ((F.col("c1") / mass) * (F.col("c2") / mass)))


def rounded(x: Column, places: int) -> Column:
    """As DuckDB rounds, by a power of ten; F.round makes a decimal number of each row's digits."""
    power = F.lit(10.0**places)
    return F.signum(x) * F.floor(F.abs(x) * power + F.lit(0.5)) / power


def every_pmi(lists: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``pmi`` of all pairs, and totals of one row (token_mass, pair_mass).

    A pair is added up where the counts of its words are known, so pairs aren't joined; but two words without
    a number are, of which there are few.
    """
    words = P.words_of(lists, window)
    totals = lists.sparkSession.range(1).select(F.lit(words.tokens).cast("long").alias("token_mass"), F.lit(words.pairs).cast("long").alias("pair_mass"))
    blocks = P.dealt(lists, words, window)
    value = _pmi(F.lit(words.tokens).cast("long"), F.lit(words.pairs).cast("long")).alias("pmi")
    found = P.added(blocks, words, True).select("t1", "t2", "n", value)
    if not words.every:
        found = found.unionByName(pmi(P.added(blocks, words, False).select("t1", "t2", "n"), words.counts, totals))
    return found, totals


def recency(staleness: Column, half_life: float | None) -> Column:
    """0.5 to the staleness over the half-life; 1 without a half-life."""
    return F.lit(1.0) if not half_life or half_life <= 0 else F.pow(F.lit(0.5), staleness / half_life)


def vocabulary(stats: DataFrame, totals: DataFrame, size: int = 200, d: float | None = 6.0, min_idf: float = 1.0, max_share: float = 0.5, seeds: dict[str, float] | None = None, half_life: float | None = None) -> DataFrame:
    """(pos, term, score): the best ``size`` terms, by score and then term.

    d <= 2 keeps what is in a tenth of the passages; up to 5 blends frequency with rarity; above,
    rarity leads.  ``seeds`` multiplies the score of its terms.  With ``half_life``, a score halves for
    every so many passages since the term's last one.
    """
    n, cf, df = F.col("doc_count"), F.col("cf"), F.col("df")
    idf = F.log2(n / df)
    table = stats.crossJoin(F.broadcast(totals)).where(F.length("term") >= 3)  # one row
    if half_life:
        table = table.crossJoin(F.broadcast(stats.agg(F.max("last_id").alias("newest"))))  # one row
    word = ~F.col("term").isin(L.VOCAB_STOPWORDS)
    if d is not None and d <= 2:
        kept, score = table.where(df >= 0.1 * n), cf * cf.cast("double")
    elif d is not None and d <= 5:
        share = 1 - d / 10
        kept, score = table.where(word), F.lit(share) * cf + F.lit(1 - share) * idf * cf
    else:
        kept, score = table.where(word & (df <= max_share * n) & (idf >= min_idf)), idf * idf * F.log2(cf + F.lit(1.0))
    if half_life:
        score = score * recency(F.col("newest") - F.col("last_id"), half_life)
    if seeds:
        boost = F.coalesce(*(F.when(F.col("term").isin([t for t, w in seeds.items() if w == weight]), weight) for weight in sorted(set(seeds.values()))), F.lit(1.0))
        score = score * boost
    best = kept.select("term", score.alias("score")).orderBy(F.desc("score"), "term").limit(size)
    return best.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "term")))


def extended(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """(pos, term): the current order, then what the fresh vocabulary has beyond it."""
    news = fresh.join(current.select("term"), "term", "left_anti")
    start = current.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("start"))
    added = news.withColumn("rank", F.row_number().over(Window.orderBy("pos"))).crossJoin(F.broadcast(start))
    return current.select("pos", "term").unionByName(added.select((F.col("rank") + F.col("start")).alias("pos"), "term"))


def links_to(vocab: DataFrame, pmis: DataFrame) -> DataFrame:
    """(term, pos, value): nonzero PMI of any term with a vocabulary term, either way round."""
    v = vocab.select(F.col("term").alias("v"), "pos")
    ways = [pmis.select(F.col(a).alias("term"), F.col(b).alias("v"), F.col("pmi").alias("value")) for a, b in (("t1", "t2"), ("t2", "t1"))]
    return ways[0].unionByName(ways[1]).where("value <> 0").join(v, "v").select("term", "pos", "value")


def surprise(lists: DataFrame, stats: DataFrame, totals: DataFrame) -> DataFrame:
    """(id, ache): mean rarity of a passage's distinct words; unseen ones count log2(N + 1)."""
    words = lists.select("id", F.explode(F.array_distinct("words")).alias("term"))
    joined = words.join(stats.select("term", "df"), "term", "left").crossJoin(F.broadcast(totals.select("doc_count")))
    rarity = F.when(F.col("df") > 0, F.log2(F.col("doc_count") / F.col("df"))).otherwise(F.log2(F.col("doc_count") + F.lit(1.0)))
    return joined.groupBy("id").agg(F.avg(rarity).alias("ache"))


def vectors(lists: DataFrame, vocab: DataFrame, links: DataFrame) -> DataFrame:
    """(id, pos, value): mean link of a passage's distinct words with each vocabulary term; zeros left out."""
    words = lists.select("id", F.explode(F.array_distinct("words")).alias("term"))
    return words.join(links, "term").groupBy("id", "pos").agg(F.avg("value").alias("value"))


def dense(sparse: DataFrame, size: int) -> DataFrame:
    """(id, vector): arrays of ``size`` values."""
    held = F.map_from_entries(F.collect_list(F.struct("pos", "value")))
    packed = sparse.groupBy("id").agg(held.alias("m"))
    return packed.select("id", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda p: F.coalesce(F.col("m")[p], F.lit(0.0))).alias("vector"))


def keywords(lists: DataFrame, stats: DataFrame, totals: DataFrame, links: DataFrame, top: int = 5, max_share: float = 0.5) -> DataFrame:
    """(id, rank, term, score): a passage's words of most rarity times link strength, ties by term."""
    strength = links.groupBy("term").agg(F.sum(F.abs("value")).alias("strength"))
    weighed = (
        stats.crossJoin(F.broadcast(totals.select("doc_count")))
        .where((F.length("term") >= 3) & (F.col("df") <= max_share * F.col("doc_count")))
        .join(strength, "term")
        .select("term", (F.log2(F.col("doc_count") / F.col("df")) * F.col("strength")).alias("score"))
        .where("score > 0")
    )
    words = lists.select("id", F.explode(F.array_distinct("words")).alias("term")).join(weighed, "term")
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "term"))
    return words.withColumn("rank", best).where(F.col("rank") <= top)


def retained_pairs(pmis: DataFrame, totals: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` pairs that add most to mutual information (a bounded saved state is the feature)."""
    gain = rounded(F.col("n") / F.col("pair_mass") * F.col("pmi"), 12)
    return pmis.crossJoin(F.broadcast(totals.select("pair_mass"))).withColumn("gain", gain).orderBy(F.desc("gain"), "t1", "t2").limit(cap)


def learn(lists: DataFrame, size: int, **options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(stats, totals, vocab, links) of a corpus: counted once, then frozen in the shared folder.

    The vocabulary comes first, so only pairs with one of its ``size`` terms are made and shuffled.
    """
    stats = cut(token_stats(lists))
    totals = cut(learned_totals(lists))
    vocab = cut(vocabulary(stats, totals, size, **options))
    pairs = pairs_around(lists, [r.term for r in vocab.select("term").collect()])  # at most ``size`` terms
    return stats, totals, vocab, cut(links_to(vocab, pmi(pairs, stats, totals)))


def propagated(lists: DataFrame, exemplars: dict[str, list[str]], stats: DataFrame, totals: DataFrame, top: int = 50_000) -> dict[str, dict[str, float]]:
    """word -> {dimension: score} from the exemplars that a word occurs with more than by chance.

    A word's dimensions are the sums of its positive PMI with exemplars, over the largest of them.
    The ``top`` words of most PMI are kept, a bound on what every task is handed.
    """
    spark = lists.sparkSession
    dims = spark.createDataFrame([(w, d) for w, own in exemplars.items() for d in own], "exemplar string, dimension string")
    near = pmi(pairs_around(lists, list(exemplars)), stats, totals).where("pmi > 0")
    ways = [near.select(F.col(a).alias("term"), F.col(b).alias("exemplar"), "pmi") for a, b in (("t1", "t2"), ("t2", "t1"))]
    sums = ways[0].unionByName(ways[1]).join(F.broadcast(dims), "exemplar").groupBy("term", "dimension").agg(F.sum("pmi").alias("x"))
    packed = sums.groupBy("term").agg(F.max("x").alias("most"), F.collect_list(F.struct("dimension", "x")).alias("own"))
    rows = packed.orderBy(F.desc("most"), "term").limit(top).collect()
    return {r.term: {o.dimension: o.x / r.most for o in r.own} for r in rows}
