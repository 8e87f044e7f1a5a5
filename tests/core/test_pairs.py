"""Pairs of words: what is shuffled for them, and their counts whatever words have numbers and however texts are cut."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from skarn.operators import corpus, pairs
from skarn.plans import registry


def shuffled(spark, run):
    """Bytes that all stages of a run wrote for a shuffle."""
    sc = spark._jsc.sc()
    total = lambda: sc.listenerBus().waitUntilEmpty(30_000) or sum(sc.statusStore().executorList(True).apply(k).totalShuffleWrite() for k in range(sc.statusStore().executorList(True).size()))
    before = total()
    run()
    return total() - before


@pytest.mark.parametrize("name", ["t03_pair_counts", "t04_pmi", "t13_retained_pairs"])
def test_pairs_take_few_bytes_of_a_shuffle(spark, sf01, tmp_path, name):
    """sf0.01 has 401,563 words; a row of two words and a count took some 20 bytes, and up to three shuffles."""
    assert 0 < shuffled(spark, lambda: registry.queries()[name](spark, sf01).write.parquet(f"{tmp_path}/out")) < 12_000_000


@pytest.fixture
def texts(spark):
    """Words of one passage, passages of one word, a long passage, and a word that is common only in some."""
    rows = ["a b a c", "", None, "x " * 9 + "y z", "zebra", "zebra", "zebra a", "rare zebra", "rare odd", "odd", " ".join(f"w{'abcdefgh'[k * k % 8]}{'xyz'[k % 3] * (k % 5)}" for k in range(400))]
    return corpus.token_lists(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3))


def brute(lists):
    n, cf = Counter(), Counter()
    for r in lists.collect():
        cf.update(r.words)
        n.update(tuple(sorted((a, b))) for i, a in enumerate(r.words) for b in r.words[i + 1 : i + 10] if a != b)
    return n, cf


@pytest.mark.parametrize("numbered", [0, 3, 12, 1_000_000])
@pytest.mark.parametrize("tokens", [1, 50, 1 << 19])
def test_pairs_do_not_depend_on_numbers_and_blocks(texts, monkeypatch, numbered, tokens):
    n, cf = brute(texts)
    monkeypatch.setattr(pairs, "NUMBERED", numbered)
    monkeypatch.setattr(pairs, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(pairs, "PART_TOKENS", 100)
    words = pairs.words_of(texts, 9)
    assert (words.tokens, words.pairs) == (sum(cf.values()), sum(n.values()))
    assert len(words.terms) <= numbered and words.every == (len(words.terms) == len(cf))
    blocks = pairs.dealt(texts, words, 9)
    rows = pairs.added(blocks, words).collect()
    assert {(r.t1, r.t2): r.n for r in rows} == n and len(rows) == len(n)
    known, others = (pairs.added(blocks, words, x).collect() for x in (True, False))
    assert {(r.t1, r.t2): r.n for r in known + others} == n and len(known) + len(others) == len(n)
    assert all(sorted((r.c1, r.c2)) == sorted((cf[r.t1], cf[r.t2])) for r in known)
    assert all(not {r.t1, r.t2} & set(words.terms.to_pylist()) for r in others)


def test_no_words(texts):
    none = texts.where(F.lit(False))
    assert corpus.pair_stats(none).count() == 0
