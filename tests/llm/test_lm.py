import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from skarn.llm import lm, packed
from skarn.llm.queries import op5_lm_score
from skarn.llm.tokens import word_hashes


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows):
    """doc -> (held_out, n_tokens, n_known, N, base) for (id, text) rows."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, x in rows:
        own = tokens(x)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        out.append((i, held(i), len(own), sum(counts[t] > 0 for t in own), total, base))
    return out


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_query(spark, sf01):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()]
    got = op5_lm_score(spark, sf01).collect()
    compare([tuple(r)[:6] for r in got], brute(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


def brute_scores(rows):
    """id -> log10 probability under the tree, from counts of one, two and three words held in memory."""
    train = [tokens(x) for i, x in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(t for own in train for t in own)
    two = Counter(p for own in train for p in zip(own, own[1:], strict=False))
    three = Counter(p for own in train for p in zip(own, own[1:], own[2:], strict=False))
    total, distinct = sum(one.values()), len(one)
    bar = math.log(max(total, 2))
    root = lambda w: (one[w] + 1) / (total + distinct + 1)

    def listed(counts, state_n, parent):
        """state -> (mass left, next word -> share)."""
        found = {}
        for (*state, w), n in counts.items():
            state = tuple(state)
            if n >= lm.LEAST_ENTRY and state_n(state) >= lm.LEAST_STATE and (p := parent(state, w)) and n * math.log(n / state_n(state) / p) > bar:
                found.setdefault(state, {})[w] = n
        return {s: ((max(state_n(s) - sum(own.values()), 0) + lm.BACKOFF) / (state_n(s) + lm.BACKOFF), {w: n / (state_n(s) + lm.BACKOFF) for w, n in own.items()}) for s, own in found.items()}

    first = listed(two, lambda s: one[s[0]], lambda s, w: root(w) if one[w] >= lm.LEAST_ENTRY else None)

    def after(a, w):
        rest, own = first.get((a,), (1.0, {}))
        return own.get(w, 0.0) + rest * root(w)

    kept = lambda a, b: two[a, b] >= lm.LEAST_ENTRY and one[a] >= lm.LEAST_STATE and one[b] >= lm.LEAST_ENTRY
    second = listed(three, lambda s: two[s] if kept(*s) else 0, lambda s, w: after(s[1], w) if kept(s[1], w) else None)

    def probability(before, w):
        if not before:
            return root(w)
        low = after(before[-1], w)
        rest, own = second.get(tuple(before), (1.0, {}))
        return own.get(w, 0.0) + rest * low

    return {i: sum(math.log10(probability(own[max(0, k - 2) : k], w)) for k, w in enumerate(own)) for i, x in rows for own in [tokens(x)]}


def test_score_against_brute_force(spark, sf01):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()]
    want = brute_scores(rows)
    got = op5_lm_score(spark, sf01).collect()
    assert all(r.score == pytest.approx(want[r.doc_id], rel=1e-9) for r in got)
    assert sum(abs(r.score - r.base_score) > 1 for r in got) > 100


def test_distributions_sum_to_one(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    tree, _ = lm.train(docs)
    assert len(tree.levels) == 2 and len(tree.levels[0].states) > 5 and len(tree.levels[1].states) > 0
    root = (tree.counts + 1) / (tree.total + tree.distinct + 1)
    other = 1 - root.sum()  # words below the share, and unknown ones
    rng = np.random.default_rng(0)
    for depth, level in enumerate(tree.levels, 1):
        for state in rng.choice(len(level.states), min(5, len(level.states)), replace=False):
            code = int(level.states[state])
            before = [tree.symbols[code]] if depth == 1 else [tree.symbols[code // tree.radix], tree.symbols[code % tree.radix]]
            n = len(tree.words)
            seq = np.concatenate([np.append(before, w) for w in tree.words] + [np.append(before, 12345)]).astype(np.uint64)
            bounds = np.arange(n + 2) * (depth + 1)
            gains = tree.gains(seq, bounds)[depth :: depth + 1]
            assert (root * 10 ** gains[:-1]).sum() + other * 10 ** gains[-1] == pytest.approx(1, rel=1e-9)


def test_longest_state_is_used(spark):
    text = "alpha beta gamma alpha beta gamma delta beta epsilon delta beta epsilon " * 40
    docs = spark.createDataFrame([(k, text) for k in range(20)], "doc_id long, text string")
    got = lm.lm_scores(docs)[0].first()
    per_word = got.score / got.n_tokens
    assert per_word > -0.25 and got.base_score / got.n_tokens < -0.6  # two words before decide the next


def test_what_is_broadcast_changes_no_score(spark, sf01, monkeypatch):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    scores = lambda: {r.row_id: r.score for r in lm.lm_scores(docs)[0].collect()}
    want = scores()
    monkeypatch.setattr(lm, "ENTRY_SHARE", 1e-3)
    got = scores()
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found, tree = lm.lm_scores(odd)
    got = [(r.row_id, r.held, r.n_tokens, r.n_known, tree.total, r.base_score) for r in found.collect()]
    compare(got, brute(rows))
    assert lm.lm_scores(empty)[0].count() == 0


def test_word_hashes_agree_with_splitting():
    import pyarrow as pa

    texts = ["a b", "", None, "Ünï  CÖDÉ x", " \t", "one\x0btwo\x0cthree\rfour\nfive", "b a" * 50_000, "É É é"]
    seen = {}
    array = pa.array(["skipped", *texts]).slice(1)
    for first, last, h, bounds in word_hashes(array):
        for k in range(first, last):
            own = h[bounds[k - first] : bounds[k - first + 1]].tolist()
            words = (texts[k] or "").encode().lower().split()
            assert len(own) == len(words)
            for word, value in zip(words, own, strict=True):
                assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_packed_columns_come_back():
    rng = np.random.default_rng(0)
    codes = np.sort(rng.integers(0, 2**64, 1000, np.uint64))
    columns = [codes, np.ones(1000, np.int64), rng.random(7), np.zeros(0, np.int64)]
    back = packed.unpack(packed.pack(*columns))
    assert all((x.view(np.uint64) == y).all() and len(x) == len(y) for x, y in zip(columns, back, strict=True))
    assert (packed.unpack(packed.pack(codes[::-1], ordered=False))[0] == codes[::-1]).all()
    part = packed.part_of(codes, 7)
    assert part[0] == 0 and part[-1] == 6 and (np.diff(part) >= 0).all()
    assert [(p, i, j) for p, i, j in packed.runs(np.array([2, 2, 5]))] == [(2, 0, 2), (5, 2, 3)]


def test_shuffles_move_few_bytes_a_token(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    moved = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = moved()
    tokens = sum(r.n_tokens for r in lm.lm_scores(docs)[0].collect())
    time.sleep(1)
    assert 0 < moved() - before < 6 * tokens  # a row an n-gram: 8 bytes a token here, more on larger tables


def test_words_are_numbered_or_not(spark, sf01, monkeypatch):
    """Few numbers, and blocks and parts that hold little: many blobs give the same sums."""
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(lm, "ENTRY_SHARE", 1e-2)
    monkeypatch.setattr(lm, "PART_TOKENS", 1 << 14)
    want = brute_scores(rows)
    got = lm.lm_scores(docs)[0].collect()
    assert len(got) == len(rows) and all(r.score == pytest.approx(want[r.row_id], rel=1e-9) for r in got)
