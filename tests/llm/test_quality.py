from skarn.llm import quality
from skarn.llm.queries import op9_quality


def test_query_agrees_with_held_out_labels(spark, sf01):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    got = {r.doc_id: r.kept for r in op9_quality(spark, sf01).collect()}
    good = [got[d] for d, q in labels.items() if q == 1]
    bad = [got[d] for d, q in labels.items() if q == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def brute_posteriors(votes, rounds=60):
    """The same model, one row at a time instead of counts of patterns."""
    import math

    k = len(quality.LABELLERS)
    p = [0.1 if quality.BAD in v else 0.95 if quality.GOOD in v else 0.5 for v in votes]
    for _ in range(rounds):
        n = [sum(1 - x for x in p), sum(p)]
        tables = [[[1.0] * 3 for _ in range(k)] for _ in range(2)]
        for v, x in zip(votes, p, strict=True):
            for j in range(k):
                tables[0][j][v[j]] += 1 - x
                tables[1][j][v[j]] += x
        like = lambda c, v: math.log((n[c] + 1) / (sum(n) + 2)) + sum(math.log(tables[c][j][v[j]] / sum(tables[c][j])) for j in range(k))  # noqa: E731, B023
        p = [1 / (1 + math.exp(max(-50, min(50, like(0, v) - like(1, v))))) for v in votes]
    return p


def test_em_matches_row_by_row(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    votes = [quality.votes(quality._read(t)[2]) for t in texts]
    counts = {}
    for t in texts:
        counts[quality.pattern(t)] = counts.get(quality.pattern(t), 0) + 1
    got = quality.posteriors(counts)
    for t, p in zip(texts, brute_posteriors(votes), strict=True):
        assert abs(got[quality.pattern(t)] - p) < 1e-6


def test_scores_match_a_plain_fit(spark, sf01):
    """The same model fitted here on all rows, which the sample holds at this size."""
    import numpy as np

    rows = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) <= quality.SAMPLE_ROWS
    read = [quality._read(r.text) for r in rows]
    posterior = brute_posteriors([quality.votes(found) for _, _, found in read])
    made = [quality.features(*x) for x in read]
    weights = quality.train([(s.tolist(), v.tolist(), p) for (s, v), p in zip(made, posterior, strict=True)])
    got = {r.doc_id: r for r in op9_quality(spark, sf01).collect()}
    for r, (slots, values), (_, words, _) in zip(rows, made, read, strict=True):
        want = 1 / (1 + np.exp(-np.clip(values @ weights[slots] + weights[-1], -50, 50))) if words else 0.0
        assert abs(got[r.doc_id].score - want) < 1e-4
        assert abs(want - 0.5) < 1e-3 or got[r.doc_id].kept == (want >= 0.5)


def test_odd_rows(spark, odd, empty):
    got = quality.classify(odd)
    assert got.columns == [*odd.columns, "quality_score", "quality_keep"]
    rows = got.collect()
    assert len(rows) == odd.count() and not any(r.quality_keep for r in rows if r.doc_id in (1, 2, 3))
    assert all(0 <= r.quality_score <= 1 for r in rows)
    assert quality.classify(empty).count() == 0
