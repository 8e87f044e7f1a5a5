"""Profiles and growth over ``documents`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import lexicon as L
from skarn.operators import corpus, formations, profile
from skarn.plans.corpus_queries import STATS, TOK, _lists, vocab_sql
from skarn.plans.registry import query, table

_SEEDS = "seeds(term, dimension) AS (VALUES " + ", ".join(f"('{t}', '{d}')" for d, terms in L.SEEDS.items() for t in terms) + ")"
_SIZE = f"WITH {TOK}, s AS (SELECT count(DISTINCT id) AS passages, count(*) AS tokens, count(DISTINCT term) AS terms FROM tok), l AS (SELECT id, count(*) AS n FROM tok GROUP BY id)"


@query(f"{_SIZE} SELECT any_value(passages) AS passages, any_value(tokens) AS tokens, any_value(terms) AS terms, round(avg(n), 6) AS mean_length, min(n) AS shortest, max(n) AS longest, round(any_value(terms / tokens), 9) AS diversity FROM s, l")
def a01_assessment(spark, sf):
    p = profile.assessment(_lists(spark, sf))
    return p.select("passages", "tokens", "terms", F.round("mean_length", 6).alias("mean_length"), F.col("shortest").cast("long").alias("shortest"), F.col("longest").cast("long").alias("longest"), F.round("diversity", 9).alias("diversity"))


@query(f"WITH {TOK}, {_SEEDS}, n AS (SELECT term, count(*) AS n FROM tok GROUP BY term) SELECT dimension, coalesce(sum(n), 0)::BIGINT AS uses, count(n) AS found, count(n) / count(*) AS share, count(n) / count(*) < 0.1 AS gap FROM seeds LEFT JOIN n USING (term) GROUP BY dimension")
def a01_seed_presence(spark, sf):
    return profile.presence(_lists(spark, sf)).select("dimension", "uses", "found", "share", "gap")


@query(
    f"WITH {TOK}, {_SEEDS}, u AS (SELECT sum(CASE WHEN dimension IN ('IC', 'CR') THEN 1 ELSE 0 END) AS warm, sum(CASE WHEN dimension IN ('KO', 'TE', 'SF', 'DE') THEN 1 ELSE 0 END) AS sober FROM tok JOIN seeds USING (term)),"
    " n AS (SELECT list_sort(list(n)) AS ns FROM (SELECT count(*) AS n FROM tok GROUP BY id))"
    " SELECT round(CASE WHEN sober > 0 THEN warm / sober ELSE 0.0 END, 6) AS warmth, ns[len(ns) // 2 + 1]::INT AS median_length FROM u, n"
)
def a01_warmth(spark, sf):
    """How warm the corpus speaks, and the upper median length of its passages."""
    lists = _lists(spark, sf)
    return profile.warmth(profile.presence(lists)).select(F.round("warmth", 6).alias("warmth")).crossJoin(profile.upper_median(lists))


_NEAR_SEEDS = (
    f"WITH {TOK}, {_SEEDS}, near AS (SELECT dimension, b.term, count(*) AS n FROM tok a JOIN seeds USING (term) JOIN tok b ON a.id = b.id AND b.pos BETWEEN a.pos - 10 AND a.pos + 10 AND b.pos <> a.pos"
    " WHERE length(b.term) >= 3 AND b.term NOT IN (" + ", ".join(f"'{w}'" for w in L.VOCAB_STOPWORDS) + ") GROUP BY 1, 2)"
)


@query(f"{_NEAR_SEEDS} SELECT dimension, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, term) AS rank FROM near) WHERE rank <= 15")
def a02_seed_neighbours(spark, sf):
    """Words within ten tokens of a seed term: seeds are found first, so only their surroundings are unfolded."""
    from pyspark.sql.window import Window

    lists = _lists(spark, sf)
    seeds = profile.seed_table(spark)
    every = F.array(*(F.lit(t) for terms in L.SEEDS.values() for t in terms))
    some = lists.where(F.arrays_overlap("words", every))
    hits = some.select("words", F.posexplode("words").alias("pos", "seed")).join(F.broadcast(seeds.withColumnRenamed("term", "seed")), "seed")
    start = F.greatest(F.lit(0), F.col("pos") - 10)
    around = F.concat(F.slice("words", start + 1, F.col("pos") - start), F.slice("words", F.col("pos") + 2, F.lit(10)))
    near = hits.select("dimension", F.explode(around).alias("term")).where((F.length("term") >= 3) & ~F.col("term").isin(L.VOCAB_STOPWORDS))
    counts = near.groupBy("dimension", "term").agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", best.cast("long")).where("rank <= 15").select("dimension", "term", "n", "rank")


@query(
    f"{_SIZE} SELECT greatest(5.0, least(8.0, 6.0 + CASE WHEN terms / tokens > 0.3 THEN 0.5 WHEN terms / tokens < 0.1 THEN -0.5 ELSE 0.0 END"
    " + CASE WHEN passages > 1000 THEN 0.5 WHEN passages < 20 THEN -0.5 ELSE 0.0 END + CASE WHEN m > 500 THEN 0.25 WHEN m < 50 THEN -0.25 ELSE 0.0 END))::DOUBLE AS d FROM s, (SELECT avg(n) AS m FROM l)"
)
def a03_calibrated_d(spark, sf):
    return profile.assessment(_lists(spark, sf)).select(profile.calibrated_d(F.col("diversity"), F.col("passages"), F.col("mean_length")).alias("d"))


_OLD_NEW = (
    f"WITH {STATS}{vocab_sql('df >= 0.1 * doc_count', '(cf * cf)::DOUBLE', 50)}, old AS (SELECT pos, term FROM vocab), "
    + vocab_sql("term NOT IN (" + ", ".join(f"'{w}'" for w in L.VOCAB_STOPWORDS) + ")", "(0.6 * cf + 0.4 * log2(doc_count / df) * cf)", 50)[2:].replace("scored", "scored2").replace("vocab AS", "fresh AS")
)


@query(
    f"{_OLD_NEW} SELECT term, o.pos AS before, n.pos AS after, CASE WHEN o.pos IS NULL THEN 'emerged' WHEN n.pos IS NULL THEN 'dissolved' WHEN abs(o.pos - n.pos) >= 5 THEN 'drifted' ELSE 'survived' END AS change FROM old o FULL JOIN fresh n USING (term)"
)
def a05_vocabulary_drift(spark, sf):
    from skarn.plans.corpus_queries import SEED_WEIGHTS

    lists = _lists(spark, sf)
    stats, totals = corpus.token_stats(lists), corpus.corpus_stats(lists)
    old, new = (corpus.vocabulary(stats, totals, 50, d=d, seeds=SEED_WEIGHTS).withColumn("pos", F.col("pos").cast("long")) for d in (1.5, 4.0))
    return formations.drift(old, new, "term", "pos").select("term", "before", "after", "change")


@query(f"{_OLD_NEW} SELECT term FROM old INTERSECT SELECT term FROM fresh")
def f17_core_vocabulary(spark, sf):
    from skarn.plans.corpus_queries import SEED_WEIGHTS

    lists = _lists(spark, sf)
    stats, totals = corpus.token_stats(lists), corpus.corpus_stats(lists)
    old, new = (corpus.vocabulary(stats, totals, 50, d=d, seeds=SEED_WEIGHTS).select("term") for d in (1.5, 4.0))
    return old.intersect(new)


@query(f"{_OLD_NEW} SELECT term FROM fresh EXCEPT SELECT term FROM old")
def u03_emerged_terms(spark, sf):
    return a05_vocabulary_drift(spark, sf).where("change = 'emerged'").select("term")


@query(
    "WITH p AS (SELECT lang, count(*) AS n, count(DISTINCT md5(text)) / count(*) AS r FROM documents GROUP BY lang)"
    " SELECT round(regr_slope(r, ln(n)), 6) AS slope, round(regr_intercept(r, ln(n)), 6) AS intercept, round(regr_r2(r, ln(n)), 6) AS r2 FROM p"
)
def a10_growth_fit(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.md5(F.col("text").cast("binary")).alias("h"))
    points = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("h") / F.count(F.lit(1))).alias("r"))
    fit = profile.growth_fit(points, "n", "r")
    return fit.select(*(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")))


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_type = 'purchase' AS helpful, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),"
    " f AS (SELECT user_id, 0::BIGINT AS k, 1.0::DOUBLE AS weight FROM e WHERE k = 1 UNION ALL"
    " SELECT f.user_id, e.k, CASE WHEN helpful THEN least(3.0, weight * 1.1::DOUBLE) ELSE greatest(0.1, weight * 0.85::DOUBLE) END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1),"
    " w AS (SELECT user_id, max(k) AS hits, arg_max(weight, k) AS weight FROM f GROUP BY user_id), l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) SELECT user_id, hits, round(CASE WHEN last < (SELECT max(ts) FROM events) - INTERVAL 7 DAY THEN greatest(0.1, weight * 0.95) ELSE weight END, 6) AS weight FROM w JOIN l USING (user_id)")
def a14_feedback(spark, sf):
    """Weights after all uses; what the last week does not use has decayed, as of the newest event."""
    events = table(spark, sf, "events").withColumn("helpful", F.col("event_type") == "purchase")
    newest = events.agg(F.max("ts").alias("t")).first()["t"]
    return profile.feedback(events, "user_id", ["ts", "event_id"], "helpful", now=F.lit(newest)).select("user_id", "hits", F.round("weight", 6).alias("weight"))


@query(
    "WITH d AS (SELECT event_type, count(*) AS hits, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6 AS days FROM events GROUP BY event_type)"
    " SELECT event_type, hits, round(hits / days, 4) AS per_day, hits / days >= 50 AS alarm FROM d WHERE days >= 1 / 24"
)
def a15_usage_rate(spark, sf):
    rate = profile.usage_rate(table(spark, sf, "events"), "event_type", "ts")
    return rate.select("event_type", "hits", F.round("per_day", 4).alias("per_day"), "alarm")


@query(
    "WITH d AS (SELECT event_type, count(*) AS hits, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS observed, (epoch_us(max(ts) FILTER (ts >= TIMESTAMP '2024-01-20')) - epoch_us(min(ts) FILTER (ts >= TIMESTAMP '2024-01-20'))) / 86400e6 AS days FROM events GROUP BY event_type)"
    " SELECT event_type, hits, round(observed / days, 4) AS per_day, observed / days >= 50 AS alarm FROM d WHERE days >= 1 / 24 AND observed > 0"
)
def a15_usage_since(spark, sf):
    """Rates of the last days alone; what came before is the baseline."""
    rate = profile.usage_rate(table(spark, sf, "events"), "event_type", "ts", since=F.lit("2024-01-20").cast("timestamp"))
    return rate.select("event_type", "hits", F.round("per_day", 4).alias("per_day"), "alarm")


@query()
def a16_docket(spark, sf):
    return profile.docket(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT lang, count(*) AS passages, count(DISTINCT source) AS members, sum(n_chars)::BIGINT AS chars, max(doc_id) AS newest FROM documents GROUP BY lang")
def a17_status(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("passages"), F.count_distinct("source").alias("members"), F.sum("n_chars").alias("chars"), F.max("doc_id").alias("newest"))


@query(
    "WITH b AS (SELECT user_id, date_trunc('hour', ts) AS h, floor(minute(ts) / 10) AS m, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3) SELECT event_id, user_id FROM b"
)
def st7_throttle(spark, sf):
    """One event per user and ten minutes: the batch form of the streaming throttle."""
    events = table(spark, sf, "events")
    return events.groupBy("user_id", F.window("ts", "10 minutes")).agg(F.min("event_id").alias("event_id")).select("event_id", "user_id")


@query("WITH d AS (SELECT day, hits, hits - lag(hits) OVER (ORDER BY day) AS d_hits FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS hits FROM events GROUP BY 1)) SELECT day, hits, d_hits FROM d")
def a07_daily_deltas(spark, sf):
    daily = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("hits"))
    return profile.deltas(daily, "day", ["hits"])


@query(
    f"WITH {STATS}, {_SEEDS}, p AS (SELECT dimension, count(cf) / count(*) < 0.1 AS gap FROM seeds LEFT JOIN stats USING (term) GROUP BY dimension)"
    " SELECT term, dimension, (CASE WHEN gap THEN 3.0 WHEN cf > 0 THEN 1.5 ELSE 2.0 END)::DOUBLE AS weight FROM seeds JOIN p USING (dimension) LEFT JOIN stats USING (term)"
)
def a04_seed_weights(spark, sf):
    lists = _lists(spark, sf)
    return profile.seed_weights(profile.presence(lists), corpus.token_stats(lists))


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_type = 'purchase' AS helpful, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),"
    " f AS (SELECT user_id, 0::BIGINT AS k, 1.0::DOUBLE AS weight FROM e WHERE k = 1 UNION ALL"
    " SELECT f.user_id, e.k, CASE WHEN helpful THEN least(3.0, weight * 1.1::DOUBLE) ELSE greatest(0.1, weight * 0.85::DOUBLE) END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1),"
    " w AS (SELECT user_id, max(k) AS hits, arg_max(weight, k) AS weight FROM f GROUP BY user_id)"
    " SELECT user_id, round(weight, 3) AS weight, hits FROM w WHERE hits > 0 ORDER BY round(weight, 3) DESC, user_id LIMIT 5"
)
def r09_load_bearing(spark, sf):
    """What is reached for most, by the feedback weights."""
    events = table(spark, sf, "events").withColumn("helpful", F.col("event_type") == "purchase")
    return profile.load_bearing(profile.feedback(events, "user_id", ["ts", "event_id"], "helpful"), "user_id")
