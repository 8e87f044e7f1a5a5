"""Routing by topics, the heart's beat, and moments: gates, ties, orphans and horizons."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.operators import profile, retrieval


def test_topics(spark):
    rows = [("paper", "n8n"), ("art-class", "art class"), ("art-class", "raw.archive"), ("desk", "start"), ("automation", "flows"), ("automation", "n8n"), ("odd", r"a\Eb"), (None, "flows")]
    topics = spark.createDataFrame(rows, "member string, keyword string")
    got = lambda m, **kw: [(r.member, r.named, r.hits) for r in retrieval.route_topics(topics, m, **kw).collect()]
    assert got("the paper on n8n flows", top=3) == [("paper", True, 1), ("automation", False, 2)]
    assert got("we start classes") == [("desk", False, 1)]  # whole words: no art class in it
    assert got("raw-archive") == [] and got("my desk") == [] and got("") == [] and got(None) == []
    assert got(r"say a\Eb now") == [("odd", False, 1)]


def test_beat(spark):
    rows = [(1, "x", "rivers of stone and gardens in spring"), (2, "x", "rivers of stone and gardens in spring"), (3, "y", "stone alone"), (4, "y", None), (5, "z", "rivers and stone walls by the sea")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 0.5)], "member string, weight double")
    prompt = "rivers stone gardens spring sea walls harbour mountains"
    got = retrieval.beat(docs, weights, prompt, "source").collect()
    assert [(r.member, r.id) for r in got] == [("x", 1), ("z", 5)]  # copies once; one word is not enough
    assert got[0].score == pytest.approx(4 / 8) and got[1].score == pytest.approx(4 / 8 * 0.5)
    assert retrieval.beat(docs, weights, "short", "source").count() == 0
    assert retrieval.beat(docs, weights, prompt + " <skip>", "source", skip=("<skip>",)).count() == 0
    assert retrieval.beat(docs.where("false"), weights, prompt, "source").count() == 0


def test_moments(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("e", k, at(10 * k)) for k in range(6)] + [(None, 9, at(0)), ("f", 20, at(0))]
    table = spark.createDataFrame(rows, "ep string, seq long, ts timestamp")
    pivots = spark.createDataFrame([("e", 3, 0.5), ("e", 4, 0.9), (None, 9, 0.4)], "ep string, seq long, gamma double")
    found = {r.ep: r for r in retrieval.episodic(table, pivots, "ep", "seq", "ts", F.lit("2024-01-03").cast("timestamp")).collect()}
    assert set(found) == {"e", None}
    e, lone = found["e"], found[None]
    assert (e.pivot, e.pivots, e.gamma, e.n_before, e.n_after, e.created) == (3, 2, 0.9, 2, 2, at(10))  # a day on either side
    assert e.relevance == pytest.approx(0.45 + 0.2 * 0.8 + 0.2 * math.exp(-(38 / 24) / 30))
    assert (lone.pivot, lone.n_before, lone.orphan) == (9, 0, True)
    assert lone.relevance == pytest.approx(0.2 + 0.2 * math.exp(-2 / 30) - 0.1)


def test_meditate(spark):
    rows = spark.createDataFrame([(k, 1.0 - k / 100, float(k)) for k in range(50)] + [(99, 2.0, None)], "id long, gamma double, age double")
    ids = lambda **kw: [r.id for r in retrieval.meditate(rows, "age", top=3, **kw).collect()]
    assert ids() == [99, 0, 1] and ids(window_days=1.0) == [0, 1]
    assert ids(dormant_days=5.0) == [5, 6, 7] and ids(dormant_days=40.0) == []  # candidates are four times as many


def test_tags_and_baseline(spark):
    tag = lambda u, a: spark.range(1).select(X.routing_tag(F.lit(u), F.lit(a), {"one": ["alpha"], "two": ["beta|gamma", "delta"]}).alias("t")).first().t
    assert [tag("ALPHA", "x"), tag("alpha", "Gamma"), tag("x", "y")] == ["one", "two", "ambient"]
    at = [dt.datetime(2024, 1, d) for d in (1, 1, 2, 5, 6)]
    events = spark.createDataFrame([("k", t) for t in at] + [("old", at[0]), ("old", at[2])], "k string, ts timestamp")
    got = profile.usage_rate(events, "k", "ts", alarm=2.0, since=F.lit("2024-01-05").cast("timestamp")).collect()
    assert [(r.k, r.hits, r.per_day, r.alarm) for r in got] == [("k", 5, 2.0, True)]


def test_snippets_and_collective(spark):
    rows = [(1, "m", "The Stone lies\n\n" + "far " * 20 + "garden " + "and " * 40, 1.0), (2, "m", "stone again", 3.0), (3, "m", "stone last", 3.0), (4, "n", "stone", 9.0), (5, "m", None, 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, member string, text string, ache double")
    keys = spark.createDataFrame([("m", "stone"), ("m", "garden"), ("m", "none")], "member string, keyword string")
    got = {r.keyword: (r.id, r.snippet) for r in retrieval.keyword_snippets(docs, keys).collect()}
    flat = " ".join(rows[0][2].split())
    at = flat.index("garden")
    assert got == {"stone": (3, "stone last"), "garden": (1, "..." + flat[at - 45 : at + 95])}
    ops = spark.createDataFrame([("a", ["x", "y", "k"]), ("a", ["x"]), ("b", ["x", "z"])], "k string, ops array<string>")
    assert tuple(profile.collective(ops, "k", "ops", ["k"]).first()) == (3, pytest.approx(3 / 4))
    assert tuple(profile.collective(ops.where("false"), "k", "ops").first()) == (0, 1.0)
