"""Keyword recall, grounding, episodes and routing over ``documents``, ``conversations`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.core.durable import cut
from skarn.functions import lexicon as L
from skarn.functions import text as X
from skarn.operators import corpus, retrieval
from skarn.functions import similarity as S
from skarn.plans.corpus_queries import HIGH, LINKS, PAIRS, PMI, STATS, TOK, VOCAB, _lists, _model
from skarn.plans import grammar_queries, registry
from skarn.plans.registry import query, table

PROBE = "the clown of nd"
MESSAGE = "the thing that was erin ondble clown disgusting nicht para avec"


def _scores_sql(probe: str) -> str:
    """CTEs that end in s(doc_id, score, matched)."""
    terms = list(enumerate(dict.fromkeys(probe.split())))
    return (
        r"WITH w AS (SELECT doc_id, lower(text) AS low, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents),"
        f" o AS (SELECT doc_id, len(ws) AS dl, contains(low, '{probe}') AS phrase, "
        + ", ".join(f"contains(low, '{t}') AS h{k}, len(list_filter(ws, lambda x: x = '{t}')) AS tf{k}" for k, t in terms)
        + " FROM w), t AS (SELECT count(*) AS n, avg(dl) AS avgdl, " + ", ".join(f"sum(h{k}::INT) AS df{k}" for k, _ in terms) + " FROM o),"
        " s AS (SELECT doc_id, CASE WHEN phrase THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END + "
        + " + ".join(f"ln((n - df{k} + 0.5) / (df{k} + 0.5) + 1) * tf{k} * 2.5 / (tf{k} + 1.5 * (0.25 + 0.75 * dl / avgdl))" for k, _ in terms)
        + " AS score, " + " + ".join(f"h{k}::INT" for k, _ in terms) + " AS matched FROM o, t)"
    )


_BASE = _scores_sql(PROBE)


@query(f"{_BASE} SELECT doc_id, round(score, 6) AS score, matched::BIGINT AS matched FROM s WHERE matched > 0")
def r03_keyword_scores(spark, sf):
    found = retrieval.keyword_scores(table(spark, sf, "documents"), PROBE)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("matched").cast("long").alias("matched"))


@query(f"{_BASE} SELECT doc_id, round(score, 6) AS score FROM s WHERE matched > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def r03_recall(spark, sf):
    return retrieval.recall(table(spark, sf, "documents"), PROBE).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(
    "SELECT doc_id, CASE WHEN p > 0 THEN substr(text, greatest(1, p - 50), p + 200 - greatest(1, p - 50)) ELSE substr(text, 1, 200) END AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'clown') AS p FROM documents)"
)
def r04_snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.snippet(F.col("text"), F.lit("clown")).alias("snippet"))


@query(
    "SELECT conv_id, count(*) AS turns, min(turn) AS first_seq, max(turn) AS last_seq, arg_min(role, turn) AS opened_by, arg_max(role, turn) AS closed_by, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id"
)
def r08_episodes(spark, sf):
    return retrieval.episodes(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query(
    "WITH f AS (SELECT *, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a FROM conversations),"
    " p AS (SELECT conv_id, min(turn) AS pv FROM f WHERE contains(lower(text), 'tion') GROUP BY conv_id)"
    " SELECT conv_id, pv AS \"pivot\", b AS n_before, a AS n_after, round(0.5 + 0.2 * (1 - 1.0 / (1 + a + b)) + 0.2 * exp(-pv / 30.0) - CASE WHEN a + b = 0 THEN 0.1 ELSE 0 END, 6) AS relevance FROM p JOIN f USING (conv_id) WHERE turn = pv"
)
def r06_moments(spark, sf):
    """Turns stand in for days of age."""
    found = retrieval.moments(table(spark, sf, "conversations"), "conv_id", "turn", F.lower("text").contains("tion"))
    around = F.col("n_before") + F.col("n_after")
    return found.withColumn("relevance", F.round(retrieval.relevance(F.lit(1.0), around, F.col("pivot"), around == 0), 6))


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS source_md5, count(*) AS parts FROM conversations GROUP BY conv_id")
def r07_episode_source(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    joined = F.array_join(F.transform(ordered, lambda s: s["text"]), "\n\n")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.md5(joined.cast("binary")).alias("source_md5"), F.count(F.lit(1)).alias("parts"))


_GROUND = ", ".join(f"'{w}'" for w in L.GROUNDING_STOPWORDS)


@query(
    f"WITH {PAIRS}, q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark),"
    f" k AS (SELECT item_id, q.term, CASE WHEN df > 0 THEN log2(doc_count / df) ELSE log2(doc_count + 1.0) END AS idf, doc_count FROM q LEFT JOIN stats USING (term), totals WHERE q.term NOT IN ({_GROUND}) AND (length(q.term) >= 4 OR df IS NOT NULL)),"
    " e AS (SELECT a.item_id, ln(1.0 + coalesce(n, 0)) * least(a.idf, b.idf) / log2(a.doc_count + 1.0) AS e FROM k a JOIN k b ON a.item_id = b.item_id AND a.term < b.term LEFT JOIN pairs ON t1 = a.term AND t2 = b.term),"
    " m AS (SELECT item_id, max(e) AS x, avg(e) AS y FROM e GROUP BY item_id)"
    " SELECT item_id, CASE WHEN coalesce(x, 0) < 0.25 THEN 'ungrounded' WHEN x <= 1.30 THEN 'thin' ELSE 'grounded' END AS band, round(coalesce(x, 0), 4) AS max_evidence, round(coalesce(y, 0), 4) AS mean_evidence FROM benchmark LEFT JOIN m USING (item_id)"
)
def r11_grounding(spark, sf):
    lists = _lists(spark, sf)
    found = retrieval.grounding(table(spark, sf, "benchmark"), cut(corpus.token_stats(lists)), lists, lists.count())
    return found.select(F.col("probe").alias("item_id"), "band", F.round("max_evidence", 4).alias("max_evidence"), F.round("mean_evidence", 4).alias("mean_evidence"))


_ROUTE = ", ".join(f"'{w}'" for w in L.ROUTING_STOPWORDS)
_INDEX = (
    f"WITH {TOK}, c AS (SELECT source AS member, term, count(*) AS tf FROM tok JOIN documents ON doc_id = id WHERE length(term) >= 3 AND term NOT IN ({_ROUTE}) GROUP BY 1, 2),"
    " d AS (SELECT term, count(*) AS members FROM c GROUP BY term), n AS (SELECT count(DISTINCT source) AS n FROM documents),"
    " r AS (SELECT member, term, tf, round(tf * ln((n + 1) / members), 6) AS weight FROM c JOIN d USING (term), n WHERE tf >= 2),"
    " i AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY weight DESC, term) AS rank FROM r)"
)


@query(f"{_INDEX} SELECT member, term, tf, weight, rank FROM i WHERE rank <= 30")
def r12_member_index(spark, sf):
    return retrieval.member_index(table(spark, sf, "documents"), "source").withColumn("rank", F.col("rank").cast("long"))


@query(f"{_INDEX} SELECT member, round(sum(weight), 5) AS score FROM i WHERE rank <= 30 AND term IN ({', '.join(repr(w) for w in sorted(set(MESSAGE.split())))}) GROUP BY member ORDER BY round(sum(weight), 6) DESC, member LIMIT 3")
def r13_route(spark, sf):
    index = retrieval.member_index(table(spark, sf, "documents"), "source")
    return retrieval.route(index, MESSAGE).select("member", F.round("score", 5).alias("score"))


@query(f"{_BASE}, r AS (SELECT source, s.doc_id, score, matched, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, s.doc_id) AS k FROM s JOIN documents USING (doc_id) WHERE matched >= 2) SELECT source, doc_id, round(score, 6) AS score, k AS rank FROM r WHERE k <= 3")
def r14_heart_bands(spark, sf):
    """The three best passages of every member for one message: one job over all members, ranked per member."""
    docs = table(spark, sf, "documents")
    scored = retrieval.keyword_scores(docs, PROBE).where("matched >= 2").join(docs.select(F.col("doc_id").alias("id"), "source"), "id")
    best = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored.withColumn("rank", best.cast("long")).where("rank <= 3").select("source", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("SELECT event_id, event_type, user_id FROM events WHERE ts > TIMESTAMP '2024-01-15' AND starts_with(event_type, 'p')")
def r16_pull_since(spark, sf):
    rows = table(spark, sf, "events").where((F.col("ts") > F.lit("2024-01-15").cast("timestamp_ntz")) & F.col("event_type").startswith("p"))
    return rows.select("event_id", "event_type", "user_id")


@query("SELECT DISTINCT regexp_extract(url, '^([a-z]+):', 1) AS mind FROM pages")
def r17_minds(spark, sf):
    return table(spark, sf, "pages").select(F.regexp_extract("url", "^([a-z]+):", 1).alias("mind")).distinct()


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' ORDER BY turn DESC, conv_id LIMIT 20")
def r18_inbox(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", "text").orderBy(F.desc("turn"), "conv_id").limit(20)


@query(r"SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[.] '), lambda x: length(trim(x)) > 0)[1] AS opening FROM conversations")
def c05_opening_sentence(spark, sf):
    parts = F.filter(F.split("text", r"[.] "), lambda x: F.length(F.trim(x)) > 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.try_element_at(parts, F.lit(1)).alias("opening"))




_TASTE = (
    f"WITH {PMI}{HIGH}{LINKS}, w AS (SELECT DISTINCT id, term FROM tok), v AS (SELECT id, pos, avg(value) AS x FROM w JOIN links USING (term) GROUP BY 1, 2),"
    " q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark WHERE item_id = 0), p AS (SELECT pos, avg(value) AS y FROM q JOIN links USING (term) GROUP BY pos),"
    " m AS (SELECT id, sum(least(abs(coalesce(x, 0)), abs(coalesce(y, 0)))) AS low FROM v LEFT JOIN p USING (pos) GROUP BY id), a AS (SELECT id, sum(abs(x)) AS sx FROM v GROUP BY id), b AS (SELECT sum(abs(y)) AS sy FROM p),"
    " g AS (SELECT id, low / (sx + sy - low) AS gamma FROM m JOIN a USING (id), b)"
)


def _probed(spark, sf, least):
    """Passages by gamma with one probe, vectorised with the frozen statistics; the probe is one broadcast row."""
    lists, _, _, vocab, links = _model(spark, sf)
    passages = corpus.dense(corpus.vectors(lists, vocab, links), VOCAB)
    probe = corpus.token_lists(table(spark, sf, "benchmark").where("item_id = 0"), "item_id")
    asked = corpus.dense(corpus.vectors(probe, vocab, links), VOCAB).select(F.col("vector").alias("asked"))
    scored = passages.crossJoin(F.broadcast(asked)).select(F.col("id").alias("doc_id"), F.round(S.gamma(F.col("vector"), F.col("asked")), 5).alias("gamma"))
    return scored.where(F.col("gamma") > least).orderBy(F.desc("gamma"), "doc_id")


@query(f"{_TASTE} SELECT id AS doc_id, round(gamma, 5) AS gamma FROM g WHERE round(gamma, 5) > 0.2 ORDER BY round(gamma, 5) DESC, id LIMIT 5")
def r01_taste(spark, sf):
    return _probed(spark, sf, 0.2).limit(5)


@query(f"{_TASTE} SELECT id AS doc_id, round(gamma, 5) AS gamma FROM g WHERE round(gamma, 5) > 0.4 ORDER BY round(gamma, 5) DESC, id LIMIT 3")
def r02_match(spark, sf):
    return _probed(spark, sf, 0.4).limit(3)


# Words that many passages have, said at length: the prompt of the heart, and the weights of its members.
BEAT = "the onou that thand erin ondble of clown nd er the at"
_WORDS = list(dict.fromkeys(BEAT.split()))
_WEIGHT = "(1 + ascii(right(source, 1)) % 4) / 4"


@query(
    f"{_scores_sql(BEAT)}, r AS (SELECT source, text, s.doc_id, matched, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, s.doc_id) AS k FROM s JOIN documents USING (doc_id) WHERE matched > 0),"
    f" e AS (SELECT source, doc_id, k, {_WEIGHT} AS weight, round(matched / {len(_WORDS)} * {_WEIGHT}, 9) AS score, substr(CASE WHEN p > 0 THEN substr(text, greatest(1, p - 50), p + 200 - greatest(1, p - 50)) ELSE substr(text, 1, 200) END, 1, 160) AS excerpt"
    f" FROM (SELECT *, instr(lower(text), '{_WORDS[0]}') AS p FROM r) WHERE k <= 3 AND matched >= 2),"
    " f AS (SELECT *, row_number() OVER (PARTITION BY substr(excerpt, 1, 60) ORDER BY score DESC, weight DESC, source, k) AS once FROM e)"
    " SELECT source, doc_id, round(score, 6) AS score FROM f WHERE once = 1 AND excerpt <> '' ORDER BY f.score DESC, weight DESC, source, k LIMIT 4"
)
def r14_beat(spark, sf):
    """What the members say to one prompt."""
    docs = table(spark, sf, "documents")
    weight = (1 + F.ascii(F.right("source", F.lit(1))) % 4) / 4
    weights = docs.select(F.col("source").alias("member")).distinct().withColumnRenamed("member", "source").select(F.col("source").alias("member"), weight.alias("weight"))
    found = retrieval.beat(docs, weights, BEAT, "source")
    return found.select(F.col("member").alias("source"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


TOPIC_MESSAGE = "der que die eau les und clown aux"


@query(
    f"{_INDEX}, t AS (SELECT member, term FROM i WHERE rank <= 30), h AS (SELECT member, count(*) AS hits FROM t WHERE regexp_matches('{TOPIC_MESSAGE}', '\\b' || term || '\\b') GROUP BY member)"
    f" SELECT member, len(list_filter(regexp_split_to_array(member, '[_\\-.]'), lambda p: length(p) > 3 AND list_contains(regexp_extract_all('{TOPIC_MESSAGE}', '[a-z]{{3,}}'), p))) > 0 AS named, hits FROM h ORDER BY named DESC, hits DESC, member LIMIT 2"
)
def r13_topics(spark, sf):
    """Members by the topics that a message touches."""
    index = retrieval.member_index(table(spark, sf, "documents"), "source")
    return retrieval.route_topics(index.select("member", F.col("term").alias("keyword")), TOPIC_MESSAGE)


@query(
    "WITH e AS (SELECT user_id, event_id, ts, array_agg(ts) OVER b AS past, array_agg(ts) OVER a AS next FROM events WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),"
    " p AS (SELECT user_id, min(event_id) AS event_id, count(*) AS pivots, max(value / 1000.0) AS gamma FROM events WHERE event_type = 'purchase' GROUP BY user_id),"
    " m AS (SELECT user_id, event_id, pivots, gamma, ts, list_filter(coalesce(past, []), lambda x: abs(epoch_us(x) - epoch_us(ts)) < 86400000000) AS past, list_filter(coalesce(next, []), lambda x: abs(epoch_us(x) - epoch_us(ts)) < 86400000000) AS next FROM p JOIN e USING (user_id, event_id)),"
    " r AS (SELECT *, len(past) AS n_before, len(next) AS n_after, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(coalesce(past[1], ts))) / 86400e6 AS age FROM m)"
    " SELECT user_id, event_id AS \"pivot\", pivots, n_before::INT AS n_before, n_after::INT AS n_after, round(0.5 * gamma + 0.2 * (1 - 1.0 / (1 + n_before + n_after)) + 0.2 * exp(-greatest(0.0, age) / 30.0), 6) AS relevance FROM r"
)
def r06_episodic(spark, sf):
    """Purchases as pivots in the users' events of one day around them."""
    events = table(spark, sf, "events")
    pivots = events.where("event_type = 'purchase'").select("user_id", "event_id", (F.col("value") / 1000.0).alias("gamma"))
    found = retrieval.episodic(events, pivots, "user_id", "event_id", "ts", F.lit("2024-02-01").cast("timestamp"))
    return found.select("user_id", "pivot", "pivots", "n_before", "n_after", F.round("relevance", 6).alias("relevance"))


_THEME = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT v FROM e WHERE vec_id = 0), s AS (SELECT b.vec_id AS id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: least(abs(p[1]), abs(p[2])))) / list_sum(list_transform(list_zip(a.v, b.v), lambda p: greatest(abs(p[1]), abs(p[2])))), 6) AS gamma FROM e b, p a), c AS (SELECT * FROM s WHERE gamma > 0 ORDER BY gamma DESC, id LIMIT 20)"


def _themed(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    probe = rows.where("id = 0").select(F.col("v").alias("p"))
    return rows.crossJoin(F.broadcast(probe)).select("id", F.round(S.gamma(F.col("p"), F.col("v")), 6).alias("gamma"), F.col("id").cast("double").alias("age"))  # one row


@query(f"{_THEME} SELECT id, gamma FROM c WHERE id <= 200 ORDER BY gamma DESC, id LIMIT 5")
def r09_recent(spark, sf):
    """The best on a theme of the last days; ids stand in for days of age."""
    return retrieval.meditate(_themed(spark, sf), "age", window_days=200.0).select("id", "gamma")


@query(f"{_THEME} SELECT id, gamma FROM c WHERE id >= 30 ORDER BY gamma DESC, id LIMIT 5")
def r09_dormant(spark, sf):
    """The best on a theme that lay quiet."""
    return retrieval.meditate(_themed(spark, sf), "age", dormant_days=30.0).select("id", "gamma")


@query("SELECT conv_id, count(*) AS parts, count(*) FILTER (length(text) >= 300) AS at_cap, count(*) FILTER (length(text) >= 300) = 0 AS complete FROM conversations GROUP BY conv_id")
def r07_fidelity(spark, sf):
    """Whether an episode's texts are whole, for a cap of 300 characters."""
    return retrieval.fidelity(table(spark, sf, "conversations"), "conv_id", "text", cap=300)


@query(f"{_TASTE} SELECT count(*) AS match_count, round(max(gamma), 5) AS best FROM g WHERE round(gamma, 5) > 0.2")
def r01_matches(spark, sf):
    """How many passages a probe matches, not only those shown."""
    return _probed(spark, sf, 0.2).agg(F.count(F.lit(1)).alias("match_count"), F.max("gamma").alias("best"))


_PROSE = registry.oracle_sql_of(grammar_queries.g24_prose.__name__)


@query(
    f"WITH {STATS}, ac AS (SELECT id, round(avg(log2(doc_count / df)), 9) AS ache FROM (SELECT DISTINCT id, term FROM tok) JOIN stats USING (term), totals GROUP BY id), {_INDEX[len(f'WITH {TOK}, '):]},"
    f" pr AS (SELECT doc_id FROM ({_PROSE}) WHERE prose), fl AS (SELECT doc_id, source, coalesce(ache, 0.0) AS ache, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS flat FROM documents JOIN pr USING (doc_id) LEFT JOIN ac ON id = doc_id),"
    " wd AS (SELECT DISTINCT doc_id, source, ache, flat, unnest(regexp_extract_all(lower(flat), '[a-z]{3,}')) AS term FROM fl),"
    " bs AS (SELECT member, w.term AS keyword, arg_max({'id': doc_id, 'flat': flat}, (ache, doc_id)) AS b FROM wd w JOIN i ON i.member = source AND i.term = w.term WHERE rank <= 30 GROUP BY 1, 2),"
    " ps AS (SELECT *, instr(lower(b.flat), keyword) AS spot FROM bs)"
    " SELECT member, keyword, b.id AS doc_id, CASE WHEN spot > 46 THEN '...' ELSE '' END || substr(b.flat, greatest(1, spot - 45), spot + 95 - greatest(1, spot - 45)) AS snippet FROM ps"
)
def r12_snippets(spark, sf):
    """What the members say with each of their terms."""
    docs, lists = table(spark, sf, "documents"), _lists(spark, sf)
    ache = corpus.surprise(lists, corpus.token_stats(lists), corpus.corpus_stats(lists)).select(F.col("id").alias("doc_id"), F.round("ache", 9).alias("ache"))
    index = retrieval.member_index(docs, "source").select("member", F.col("term").alias("keyword"))
    prose = docs.where(X.is_prose(F.col("text"))).join(ache, "doc_id", "left").withColumnRenamed("source", "member")
    return retrieval.keyword_snippets(prose, index).select("member", "keyword", F.col("id").alias("doc_id"), "snippet")
