"""Fusion against a plain version of its levels, rebuilds, merged files, and comparisons of corpora."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skarn.functions import lexicon as L
from skarn.operators import coupling, formations, fusion, portrait

SEEDS = {t: 2.0 for terms in L.SEEDS.values() for t in terms}


def corpus_of(n, seed):
    rng = random.Random(seed)
    topics = [[f"{c}{v}{k}" for c in "bdk" for v in "ao"] for k in ("lin", "mor", "tus", "vex")]
    return [" ".join(rng.choice(topics[i // 5 % 4]) if rng.random() < 0.8 else rng.choice(rng.choice(topics)) for _ in range(rng.randint(20, 40))) for i in range(n)]


def plain_vocabulary(cf, df, n, size, d, seeds, narrow):
    warm = narrow and d <= 2
    score = {}
    for t in cf:
        if len(t) < 3:
            continue
        idf = math.log2(n / df[t])
        if d <= 2:
            if df[t] < 0.1 * n:
                continue
            s = cf[t] ** 2
        elif t in L.VOCAB_STOPWORDS:
            continue
        elif d <= 5:
            s = (1 - d / 10) * cf[t] + d / 10 * idf * cf[t]
        elif df[t] > 0.5 * n or idf < 1:
            continue
        else:
            s = idf * idf * math.log2(cf[t] + 1)
        score[t] = s * seeds.get(t, 1.0)
    found = sorted(score, key=lambda t: (-score[t], t))[:size]
    kept = [t for t in found if t not in L.VOCAB_STOPWORDS]
    return kept if warm and len(kept) >= 20 else found


def plain_partition(words, vocab, theta):
    n, cf = len(words), Counter(w for ws in words for w in ws)
    df = Counter(w for ws in words for w in set(ws))
    pairs = Counter(tuple(sorted((a, b))) for ws in words for i, a in enumerate(ws) for b in ws[i + 1 : i + 10] if a != b)
    mass, tokens = sum(pairs.values()), sum(cf.values())
    pmi = {p: math.log2(c / mass / (cf[p[0]] / tokens * cf[p[1]] / tokens)) for p, c in pairs.items()}
    vectors = []
    for ws in words:
        ache = sum(math.log2(n / df[w]) for w in set(ws)) / len(set(ws))
        row = []
        for v in vocab:
            own = [x for w in set(ws) if (x := pmi.get(tuple(sorted((w, v))), 0))]
            row.append(ache * sum(own) / len(own) if own else 0.0)
        vectors.append(row)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i + 1, min(n, i + 20)):
            a, b = vectors[i], vectors[j]
            low, high = (sum(f(abs(x), abs(y)) for x, y in zip(a, b, strict=True)) for f in (min, max))
            if high and low / high >= theta:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    sizes = Counter(find(i) for i in range(n))
    return [str(find(i)) if sizes[find(i)] > 1 else fusion.UNCOUPLED for i in range(n)]


def plain_nmi(a, b):
    n = len(a)
    h = lambda x: -sum(c / n * math.log2(c / n) for c in Counter(x).values())
    ca, cb = Counter(a), Counter(b)
    mi = sum(c / n * math.log2(c * n / (ca[x] * cb[y])) for (x, y), c in Counter(zip(a, b, strict=True)).items())
    mean = (h(a) + h(b)) / 2
    return 1.0 if mean <= 0 else mi / mean


def plain_fuse(texts, size, theta, stop):
    words = [t.split() for t in texts]
    cf, df = Counter(w for ws in words for w in ws), Counter(w for ws in words for w in set(ws))
    out, seeds, times, d = [], SEEDS, 0, 6.0
    while len(out) < 5 and d >= 0.5:
        def look(narrow):
            return plain_vocabulary({t: c * times for t, c in cf.items()}, {t: c * times for t, c in df.items()}, len(words) * times, size, d, seeds, narrow)  # noqa: B023
        times += 1
        terms, epochs = look(bool(out)), 1
        for cycle in range(2, 11):
            times += 1
            fresh, epochs = look(False), cycle
            if fresh[:20] == terms[:20]:
                break
            terms = fresh
        if not terms:
            break
        labels = plain_partition(words, terms, theta)
        out.append((d, epochs, terms, labels, plain_nmi(out[-1][3], labels) if out else None))
        if (out[-1][4] or 0) >= stop:
            break
        seeds, d = {t: 1.5 for t in terms[:80]}, d - 1.5
    return out


def test_fusion_is_the_plain_one(spark):
    texts = corpus_of(40, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    theta = 0.45
    got = fusion.fuse(docs, size=12, theta=theta, split=False, stop=1.5)
    want = plain_fuse(texts, 12, theta, 1.5)
    assert len(got) == len(want) == 4
    heads = [t[:80].lower().strip() for t in texts]
    for level, (d, epochs, terms, labels, nmi) in zip(got, want, strict=True):
        assert (level.d, level.epochs, level.vocabulary) == (d, epochs, terms)
        assert {r.fp: r.label for r in level.partition.collect()} == dict(zip(heads, labels, strict=True))
        assert level.nmi == (None if nmi is None else pytest.approx(nmi))
    assert fusion.core(got) == sorted(set.intersection(*(set(t) for _, _, t, _, _ in want)))
    classes = Counter(zip(*(labels for *_, labels, _ in want), strict=True))
    assert sorted(r["size"] for r in fusion.iron(got).collect()) == sorted(c for c in classes.values() if c > 1)


def test_fusion_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fusion.fuse(empty) == [] and fusion.core([]) == []


def test_rebuild_modes(spark):
    rows = spark.createDataFrame([(i, [1.0, i / 40]) for i in range(30)], "seq long, v array<double>")
    whole = coupling.couple(rows, "seq", "v", 0.9)
    every = {tuple(r) for r in whole.select("src", "dst").collect()}
    none = whole.where("false")
    mode, full = coupling.rebuild(rows, "seq", "v", 0.9, none)
    assert mode == "full" and {(r.src, r.dst) for r in full.collect()} == every
    mode, grown = coupling.rebuild(rows, "seq", "v", 0.9, whole.where("dst < 20"))
    assert mode == "appended" and {(r.src, r.dst) for r in grown.collect()} == every
    assert {r.step for r in grown.collect()} == {"kept", "appended"}
    assert coupling.rebuild(rows, "seq", "v", 0.9, whole)[0] == "none"
    assert coupling.rebuild(rows, "seq", "v", 0.9, whole, whole=True)[0] == "full"


def test_files_merge_to_the_aggregates(spark):
    rng = random.Random(5)
    rows = [(rng.choice("AB"), i, rng.choice([None, "x", "y"]), rng.choice([None, 0.0, rng.random()]), [rng.random() for _ in range(8)], rng.choice("pqr")) for i in range(60)]
    members = spark.createDataFrame(rows, "address string, id long, source string, ache double, vector array<double>, norm string")
    parts = [formations.filed(members.where(F.col("id") % 3 == k)) for k in range(3)]
    key = lambda t: sorted((r.address, r.size, r.minds, r.distinct_texts, r.representative, round(r.mean_ache, 9), round(r.score, 9)) for r in t.collect())
    assert key(formations.from_files(formations.merged_files(*parts))) == key(formations.aggregates(members))


def test_names_tiers(spark):
    rows = [("A", "millet millet painters peasant"), ("A", "millet painted peasant other"), ("B", "alone"), ("C", "the this an"), ("D", None)]
    found = portrait.names(spark.createDataFrame(rows, "k string, text string"), "k", "text")
    got = {r.k: r.name for r in found.collect()}
    assert got["A"].startswith("MILLET_PEASANT") and got["B"] == "ALONE" and "C" not in got and "D" not in got


def test_compare_and_drift(spark):
    items = lambda *x: spark.createDataFrame([(i,) for i in x], "item string")
    r = portrait.compare(items("a", "b", "b"), items("b", "c", "d"), "item").first()
    assert (r.stable, r.added, r.removed, r.stability, r.churn) == (1, 2, 1, pytest.approx(1 / 3), 0.75)
    r = portrait.compare(items(), items(), "item").first()
    assert (r.stable, r.stability, r.churn) == (0, 0.0, 0.0)
    counts = lambda words: spark.createDataFrame([(w, 100 - i) for i, w in enumerate(words)], "term string, cf long")
    moved = portrait.rank_drift(counts("abcdefgh"), counts("hbcdefga"))
    assert {r.term: r.change for r in moved.collect()} == {"a": -7, "h": 7}


def test_codebook(spark):
    rows = [("ACTING", 3, 0.5, *([0.0] * 6), 0.4, 0.1, "we  build\nit", ["build", "it"]), ("FEELING", 9, None, *([0.0] * 8), None, None), ("TESTING", 1, 0.9, 0.0, 0.2, *([0.0] * 6), "a test", [])]
    found = spark.createDataFrame(rows, "address string, size long, score double, " + ", ".join(f"c{k} double" for k in range(8)) + ", text string, keywords array<string>")
    text = formations.codebook(found)
    assert text.index("**TESTING** (1 passages, testing, score=0.900)") < text.index("**ACTING** (3 passages, acting+reflecting, score=0.500)") < text.index("**FEELING** (9 passages)")
    assert '  "we build it"' in text and "themes: build" in text and "3 formations, 13 passages" in text
    assert "0 formations" in formations.codebook(found.where("false"))


@pytest.mark.parametrize("common", [1, 5, 1000])
def test_common_and_rare_words_give_the_same_vectors(spark, common):
    """Words from the broadcast table and words that are joined add up to what rows of words and links give."""
    from skarn.operators import corpus

    texts = [*corpus_of(60, 8), "onlyonce again", "", "solitary"]
    lists = corpus.token_lists(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    stats, totals, vocab, links = corpus.learn(lists, 7, d=4.0)
    packs, names = fusion.packed(lists, stats, common)
    assert packs.agg(F.sum("pairs")).first()[0] == totals.first().pair_mass and names.count() == min(common, stats.count())
    packs = fusion.surprise(packs, names, stats, totals)
    ache = corpus.surprise(lists, stats, totals)
    assert {r.id: r.ache for r in packs.collect()} == pytest.approx({r.id: r.ache for r in ache.collect()})
    want = corpus.vectors(lists, vocab, links).join(ache, "id").select("id", "pos", (F.col("value") * F.col("ache")).alias("value"))
    rows = fusion.weighed(packs, names, links, 7)
    got, want = ({r.id: r.vector for r in t.collect()} for t in (rows, corpus.dense(want, 7)))
    assert got.keys() == want.keys() and len(got) < len(texts)
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    near = {(r.src, r.dst): r.gamma for r in coupling.near_gammas(rows, "id", "vector").collect()}
    pairs = {(r.src, r.dst): r.gamma for r in coupling.couple(rows, "id", "vector", 0.0).collect()}
    assert near == pytest.approx(pairs) and len(near) > 500


def test_near_pairs_over_blocks_gaps_and_signs(spark, monkeypatch):
    monkeypatch.setattr(coupling, "NEAR_BITS", 4)
    rng = random.Random(9)
    ids = [*range(-40, 30), 100, 118, 138, *range(200, 300, 7)]
    rows = spark.createDataFrame([(i, [rng.choice([0.0, 0.0, rng.random() - 0.5]) for _ in range(3)]) for i in ids], "id long, v array<double>")
    near = {(r.src, r.dst): r.gamma for r in coupling.near_gammas(rows, "id", "v").collect()}
    assert near == pytest.approx({(r.src, r.dst): r.gamma for r in coupling.couple(rows, "id", "v", 0.0).collect()})
    assert near.keys() == {(a, b) for a in ids for b in ids if 1 <= b - a <= 19}


def test_names_look_at_texts_once(spark):
    looks = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def looked(x):
        looks.add(1)
        return x

    texts = corpus_of(40, 6)
    docs = spark.createDataFrame([(k % 3, t) for k, t in enumerate(texts)], "k long, text string")
    plain = {r.k: r.name for r in portrait.names(docs, "k", "text").collect()}
    assert {r.k: r.name for r in portrait.names(docs.select("k", looked("text").alias("text")), "k", "text").collect()} == plain
    assert looks.value == len(texts)
    uses = {(r.key, r.word): (r.tf, r.df) for r in portrait.word_uses(docs, "k", "text").collect()}
    words = [(str(k % 3), w) for k, t in enumerate(texts) for w in t.split() if len(w) >= 4]
    once = [(str(k % 3), w) for k, t in enumerate(texts) for w in {"", *t.split()} if len(w) >= 4 or not w]
    assert uses == {x: (Counter(words)[x] if x[1] else n, n) for x, n in Counter(once).items()}


def test_totals_and_addresses_without_repeated_work(spark):
    from skarn.functions import text as X
    from skarn.operators import corpus

    lists = corpus.token_lists(spark.createDataFrame([(0, "a b a a c"), (1, "d"), (2, "e e f g h i j k l m n o p")], "doc_id long, text string"))
    words = [r.words for r in lists.collect()]
    pairs = sum(a != b for ws in words for i, a in enumerate(ws) for b in ws[i + 1 : i + 10])
    assert tuple(corpus.learned_totals(lists).first()) == (3, sum(map(len, words)), pairs)
    assert tuple(corpus.learned_totals(lists.where("false")).first()) == (0, 0, 0)
    plan = lists.select(X.address(X.structural(F.concat_ws(" ", "words"))))._jdf.queryExecution().analyzed().toString()
    once = lists.select(X.structural(F.concat_ws(" ", "words")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_count") == once.count("regexp_count") > 0  # it was written out for every use of the vector
    groups = spark.createDataFrame([(["x", "y"], False), (["y"], True), (["z", "x"], False)], "items array<string>, thick boolean")
    assert {r.term for r in coupling.gap_keywords(groups, "items", "thick").collect()} == {"x", "z"}
