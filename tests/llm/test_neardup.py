from collections import defaultdict

import numpy as np

from skarn.llm import neardup


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def similar_pairs(docs):
    """Every pair with similarity above 0, by shared shingles."""
    held = {i: shingles(t) for i, t in docs.items()}
    where = defaultdict(list)
    for i, s in held.items():
        for g in s:
            where[g].append(i)
    shared = defaultdict(int)
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                shared[b, a] += 1
    return {(a, b): n / (len(held[a]) + len(held[b]) - n) for (a, b), n in shared.items()}


def edit(text, rng, share):
    w = text.split()
    for k in rng.choice(len(w), max(1, int(share * len(w))), replace=False):
        w[k] = f"other{rng.integers(10**6)}"
    return " ".join(w)


def test_classes_against_all_pairs(spark, sf01):
    rng = np.random.default_rng(4)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    long = [t for t in docs.values() if len(t.split()) > 80][:150]
    docs |= {10_000 + k: edit(t, rng, 0.02) for k, t in enumerate(long)}
    docs |= {20_000 + k: edit(long[0], rng, 0.01) for k in range(60)}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.id: r.component for r in neardup.classes(rows).collect()}
    assert len(got) == len(docs)
    pairs = similar_pairs(docs)
    near = [p for p, j in pairs.items() if j >= 0.8]
    assert len(near) > 200
    assert sum(got[a] == got[b] for a, b in near) >= 0.97 * len(near)
    loose = defaultdict(set)  # every class hangs together at a similarity of a half
    for (a, b), j in pairs.items():
        if j >= 0.5:
            loose[a].add(b)
            loose[b].add(a)
    members = defaultdict(set)
    for i, c in got.items():
        members[c].add(i)
    for c, own in members.items():
        assert c == min(own)
        if len(own) > 1 and all(len(docs[i].split()) >= 20 for i in own):
            seen, queue = {c}, [c]
            while queue:
                new = (loose[queue.pop()] & own) - seen
                seen |= new
                queue += new
            assert seen == own


def test_keep_one_and_odd_rows(spark, odd, empty):
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted([1, 4, 5, 6, 7, None, 9, 10, 11], key=repr)
    assert neardup.keep_one(empty).count() == 0


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def made(rng, n, tag):
    return [f"{tag}{k}" for k in rng.integers(0, 5000, n)]


def test_recall_on_passages_appended_cut_and_moved(spark):
    rng = np.random.default_rng(8)
    docs, pairs = {}, []
    for k in range(240):
        own = made(rng, [60, 400, 3000][k % 3], f"d{k}w")
        n = len(own)
        extra = made(rng, int(n * 0.2), f"e{k}w")
        other = [own + extra, own[: int(n * 0.84)], own[n // 3 : 2 * n // 3] + own[: n // 3] + own[2 * n // 3 :]][k // 3 % 3]
        docs[2 * k], docs[2 * k + 1] = " ".join(own), " ".join(other)
        if jaccard(docs[2 * k], docs[2 * k + 1]) >= 0.8:
            pairs.append((2 * k, 2 * k + 1))
    assert len(pairs) > 200
    got = {r.id: r.component for r in neardup.classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)


def test_texts_below_the_similarity_stay_apart(spark):
    rng = np.random.default_rng(9)
    docs = {}
    for k in range(200):
        docs[2 * k] = " ".join(made(rng, 400, f"d{k}w"))
        docs[2 * k + 1] = edit(docs[2 * k], rng, rng.uniform(0.05, 0.1))
    low = [k for k in range(200) if 0.5 <= jaccard(docs[2 * k], docs[2 * k + 1]) < 0.78]
    assert len(low) > 100
    got = {r.id: r.component for r in neardup.classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert all(got[2 * k] != got[2 * k + 1] for k in low)


def test_a_chain_of_near_copies_is_one_class(spark, monkeypatch):
    """The ends are unlike; each is like its neighbours alone."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rng = np.random.default_rng(10)
    own = made(rng, 2000, "w")
    docs = [(k, " ".join(own[12 * k : 12 * k + 400])) for k in range(130)]
    assert jaccard(docs[0][1], docs[-1][1]) == 0
    got = {r.component for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0}


def test_blocks_lose_no_pair(spark, monkeypatch):
    """Many texts that share a template, in pairs alike: whatever the size of a block, the same classes."""
    rng = np.random.default_rng(12)
    template = made(rng, 240, "t")
    docs = []
    for k in range(60):
        own = template + made(rng, 120, f"own{k}w")
        docs += [(2 * k, " ".join(own)), (2 * k + 1, edit(" ".join(own), rng, 0.01))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = []
    for size in (7, 2048):
        monkeypatch.setattr(neardup, "BLOCK", size)
        got.append({r.id: r.component for r in neardup.classes(table).collect()})
    assert got[0] == got[1]
    assert all(got[0][2 * k + 1] == got[0][2 * k] for k in range(60)) and len(set(got[0].values())) == 60
