import re
from collections import Counter

from skarn.llm import repetition
from skarn.llm.queries import op10_repetition
from tests.llm.conftest import TEXTS


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + j for k in range(len(words) - 2) if counts[tuple(words[k : k + 3])] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed)


def brute_share(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, hit = set(), set()
    for k in range(len(words) - n + 1):
        gram = tuple(words[k : k + n])
        if gram in seen:
            hit |= set(range(k, k + n))
        seen.add(gram)
    return sum(len(words[k]) for k in hit) / max(1, sum(map(len, words)))


def test_query_matches_brute_force(spark, sf01):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    got = op10_repetition(spark, sf01).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:7] == brute(docs[r.doc_id])
        assert not (r.kept and r.base_failed)
    clean = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)


def test_shares_match_brute_force(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        m = repetition.measure(r.text)
        for n, share in zip(repetition.NGRAM_SHARES, m["ngram_shares"], strict=True):
            assert abs(share - brute_share(r.text, n)) < 1e-12


def test_odd_rows(odd, empty):
    got = repetition.repetition(odd).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        m = r.repetition
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, r.base_failed) == brute(r.text)
    assert repetition.repetition(empty).count() == 0
