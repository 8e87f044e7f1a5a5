import re
from collections import Counter

import numpy as np
import xxhash

from skarn.llm import simhash
from skarn.llm.queries import op2_simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_classes(rows):
    """rows of (id, fp) -> (id, component) by comparing every pair."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, least.get(find(k))) for k, (i, _) in enumerate(rows))


def test_query_matches_brute_force(spark, sf01):
    got = op2_simhash(spark, sf01).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        assert r.fingerprint == f"{brute_fingerprint(docs[r.doc_id]):016x}"
    assert Counter((r.doc_id, r.component_id) for r in got) == brute_classes([(r.doc_id, int(r.fingerprint, 16)) for r in got])


def test_links_are_complete_around_planted_neighbours(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**64, 200, dtype=np.uint64)]
    fps = set(base)
    for x in base:
        for flips in (1, 2, 3):
            y = x
            for b in rng.choice(64, flips, replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    signed = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    from skarn.operators.components import connected_components

    got = connected_components(simhash.links(signed)).collect()
    classes = {r.node % 2**64: r.component for r in got}
    pairs = [(k, f) for k, f in enumerate(fps)]
    want = brute_classes(pairs)
    mine = {}
    for k, f in enumerate(fps):
        mine.setdefault(classes.get(f, ("alone", f)), []).append(k)
    theirs = {}
    for (k, c), _ in want.items():
        theirs.setdefault(c, []).append(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.component for r in got if r.id in (1, 2, 3)} == {1}
    assert {r.component for r in got if r.id in (7, 8)} == {7}
    assert [r.component for r in got if r.id is None] == [None]
    assert simhash.near_duplicates(empty).count() == 0
