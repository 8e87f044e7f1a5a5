"""Retrieval: keyword ranking, grounding of queries, episodes, routing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.core.durable import cut
from skarn.functions import lexicon as L
from skarn.operators import corpus

K1, B, PHRASE_BONUS = 1.5, 0.75, 3.0


def _equals(term: str):
    return lambda word: word == term


def keyword_scores(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, matched) of every passage that contains a query word.

    Passages qualify, and document frequencies count, by containment; term frequencies by whole
    words; the whole query as a phrase earns a bonus.  One pass: the frequencies are one row.
    """
    terms = list(dict.fromkeys(query.lower().split()))
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    words = F.filter(F.split(low, r"[ \t\n\x0b\f\r]+"), lambda w: w != "")
    counted = lambda x: F.struct(F.size(x).alias("dl"), F.filter(x, lambda w: w.isin(terms)).alias("hits"))  # noqa: E731  a text is split once
    read = docs.select(
        F.col(id_col).alias("id"),
        F.element_at(F.transform(F.array(words), counted), 1).alias("c"),
        F.array(*(low.contains(t) for t in terms)).alias("has"),
        low.contains(query.lower().strip()).alias("phrase"),
    )
    own = cut(read.select("id", "c.dl", "has", F.array(*(F.size(F.filter("c.hits", _equals(t))) for t in terms)).alias("tf"), "phrase"))
    totals = own.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.sum(F.col("has")[k].cast("int")).alias(f"df{k}") for k in range(len(terms))))
    joined = own.crossJoin(F.broadcast(totals))  # one row
    score = F.when(F.col("phrase"), PHRASE_BONUS).otherwise(0.0)
    for k in range(len(terms)):
        df, tf = F.col(f"df{k}"), F.col("tf")[k]
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    matched = sum((F.col("has")[k].cast("int") for k in range(1, len(terms))), F.col("has")[0].cast("int"))
    return joined.select("id", score.alias("score"), matched.alias("matched")).where("matched > 0")


def recall(docs: DataFrame, query: str, top: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The best passages for a query, ties by id."""
    return keyword_scores(docs, query, id_col, text_col).orderBy(F.desc(F.round("score", 9)), "id").limit(top)


def informative(probes: DataFrame, stats: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(probe, term, df): words of a probe that are no stop words, and long or known."""
    from skarn.functions.text import tokens

    words = probes.select(F.col(id_col).alias("probe"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    words = words.where(~F.col("term").isin(L.GROUNDING_STOPWORDS)).join(stats.select("term", "df"), "term", "left")
    return words.where((F.length("term") >= 4) | F.col("df").isNotNull()).select("probe", "term", F.coalesce("df", F.lit(0)).alias("df"))


#: Word pairs of probes that are counted by a map-side join; more probes than that are grounded in several calls.
MAX_PROBE_PAIRS = 2_000_000


def grounding(probes: DataFrame, stats: DataFrame, lists: DataFrame, doc_count: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(probe, band, max_evidence, mean_evidence): how much co-occurrence backs each probe's word pairs.

    The probes' pairs come first, and only these are counted in the passages.
    """
    words = informative(probes, stats, id_col, text_col)
    top = F.log2(F.lit(doc_count + 1.0))
    rarity = F.when(F.col("df") > 0, F.log2(doc_count / F.col("df"))).otherwise(top)
    rated = cut(words.select("probe", "term", rarity.alias("idf")))
    a = rated.select("probe", F.col("term").alias("t1"), F.col("idf").alias("i1"))
    b = rated.select("probe", F.col("term").alias("t2"), F.col("idf").alias("i2"))
    asked = cut(a.join(b, "probe").where("t1 < t2"))
    wanted = cut(asked.select("t1", "t2").distinct())
    if wanted.count() > MAX_PROBE_PAIRS:
        raise ValueError(f"more than {MAX_PROBE_PAIRS} word pairs are asked for at once")
    terms = [r.term for r in rated.select("term").distinct().collect()]  # no more than twice the pairs
    both = asked.join(corpus.pairs_among(lists, terms, wanted), ["t1", "t2"], "left")
    evidence = F.log1p(F.coalesce("n", F.lit(0)).cast("double")) * F.least("i1", "i2") / top
    sums = both.groupBy("probe").agg(F.max(evidence).alias("max_evidence"), F.avg(evidence).alias("mean_evidence"))
    out = probes.select(F.col(id_col).alias("probe")).join(sums, "probe", "left").fillna(0.0, ["max_evidence", "mean_evidence"])
    band = F.when(F.col("max_evidence") < 0.25, "ungrounded").when(F.col("max_evidence") <= 1.30, "thin").otherwise("grounded")
    return out.select("probe", band.alias("band"), "max_evidence", "mean_evidence")


def episodes(rows: DataFrame, key: str, seq: str, who: str, text: str) -> DataFrame:
    """Per episode: size, span, first and last speaker, characters."""
    at = F.struct(F.col(seq).isNull(), F.col(seq))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("turns"),
        F.min(seq).alias("first_seq"),
        F.max(seq).alias("last_seq"),
        F.min_by(who, at).alias("opened_by"),
        F.max_by(who, F.col(seq)).alias("closed_by"),
        F.sum(F.length(text)).cast("long").alias("chars"),
    )


def moments(rows: DataFrame, key: str, seq: str, hit: Column, before: int = 5, after: int = 5) -> DataFrame:
    """Each episode's earliest hit with the counts and bounds of the rows around it."""
    order = Window.partitionBy(key).orderBy(seq)
    framed = rows.withColumn("n_before", F.count(F.lit(1)).over(order.rowsBetween(-before, -1))).withColumn("n_after", F.count(F.lit(1)).over(order.rowsBetween(1, after)))
    pivots = framed.where(hit).groupBy(key).agg(F.min_by(F.struct(F.col(seq).alias("pivot"), "n_before", "n_after"), F.col(seq)).alias("m"))
    return pivots.select(key, "m.*")


def relevance(gamma: Column, around: Column, age_days: Column, orphan: Column) -> Column:
    return 0.5 * gamma + 0.2 * (1 - 1.0 / (1 + around)) + 0.2 * F.exp(-age_days / 30.0) - F.when(orphan, 0.1).otherwise(0.0)


def member_index(docs: DataFrame, member: str, id_col: str = "doc_id", text_col: str = "text", top: int = 30, least: int = 2) -> DataFrame:
    """(member, term, tf, weight, rank): each member's terms of most tf times ln((N+1)/members with it)."""
    from skarn.functions.text import tokens

    words = docs.select(F.col(member).alias("member"), F.explode(tokens(F.col(text_col))).alias("term"))
    words = words.where((F.length("term") >= 3) & ~F.col("term").isin(L.ROUTING_STOPWORDS))
    counts = words.groupBy("member", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("members"))
    n = docs.agg(F.count_distinct(member).alias("n"))
    weight = F.col("tf") * F.log((F.col("n") + 1) / F.col("members"))
    rated = counts.where(F.col("tf") >= least).join(df, "term").crossJoin(F.broadcast(n)).withColumn("weight", F.round(weight, 6))
    best = F.row_number().over(Window.partitionBy("member").orderBy(F.desc("weight"), "term"))
    return rated.withColumn("rank", best).where(F.col("rank") <= top).select("member", "term", "tf", "weight", "rank")


def route(index: DataFrame, message: str, top: int = 3, floor: float = 0.0) -> DataFrame:
    """(member, score): members whose index terms the message has, by weight."""
    said = sorted(set(re.findall("[a-z]+", message.lower())))
    hits = index.where(F.col("term").isin(said)).groupBy("member").agg(F.sum("weight").alias("score"))
    return hits.where(F.col("score") >= floor).orderBy(F.desc(F.round("score", 6)), "member").limit(top)


def topic_scores(topics: DataFrame, message: str, least: int = 1) -> DataFrame:
    """(member, named, hits) of members with a keyword (member, keyword) in the message as whole words.

    A name alone wakes no member; ``named`` says that a part of over three letters of a hit member's
    name is one of the message's words.
    """
    low = (message or "").lower()
    said = sorted(set(re.findall("[a-z]{3,}", low)))
    bounded = F.concat(F.lit(r"\b\Q"), F.lower("keyword"), F.lit(r"\E\b"))
    hits = topics.where(F.col("member").isNotNull()).where(F.rlike(F.lit(low), bounded)).groupBy("member").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least)
    parts = F.filter(F.split("member", r"[_\-.]"), lambda p: (F.length(p) > 3) & p.isin(said))
    return hits.select("member", (F.size(parts) > 0).alias("named"), "hits")


def route_topics(topics: DataFrame, message: str, top: int = 2, least: int = 1) -> DataFrame:
    """The members that a message is for: first those it names, then by keywords hit, ties by member."""
    return topic_scores(topics, message, least).orderBy(F.desc("named"), F.desc("hits"), "member").limit(top)


def gated(prompt: str | None, least: int = 40, skip: tuple[str, ...] = ()) -> bool:
    """Whether a prompt stays unanswered: too short, or marked to be skipped."""
    text = (prompt or "").strip()
    return len(text) < least or any(marker in text for marker in skip)


def beat(docs: DataFrame, weights: DataFrame, prompt: str, member: str, id_col: str = "doc_id", text_col: str = "text", each: int = 3, matched: int = 2, top: int = 4, excerpt: int = 160, least: int = 40, skip: tuple[str, ...] = ()) -> DataFrame:
    """(member, id, score, excerpt): what the members' best passages say to a prompt, by share of its words times weight.

    A gated prompt gives no rows.  Of every member the ``each`` best passages count if ``matched`` words
    are in them; excerpts that begin with the same 60 characters count once.  ``weights``: (member,
    weight), heavier members first among equals, then by member and rank.
    """
    from skarn.functions.text import snippet

    text = " ".join((prompt or "").split())[:200]
    terms = list(dict.fromkeys(text.lower().split())) or [""]
    own = docs.select(F.col(id_col).alias("id"), F.col(member).alias("member"), snippet(F.coalesce(F.col(text_col), F.lit("")), F.lit(terms[0])).alias("snippet"))
    if gated(prompt, least, skip):
        return own.where("false").select("member", "id", F.lit(0.0).alias("score"), F.col("snippet").alias("excerpt"))
    found = keyword_scores(docs, text, id_col, text_col).join(own.select("id", "member"), "id").join(weights, "member")
    best = F.row_number().over(Window.partitionBy("member").orderBy(F.desc(F.round("score", 9)), "id"))
    ranked = found.withColumn("rank", best).where((F.col("rank") <= each) & (F.col("matched") >= matched))
    ranked = ranked.join(own.select("id", F.substring("snippet", 1, excerpt).alias("excerpt")), "id")  # at most ``each`` a member
    share = F.round(F.col("matched") / len(terms) * F.col("weight"), 9)
    order = (F.desc("share"), F.desc("weight"), "member", "rank")
    once = F.row_number().over(Window.partitionBy(F.substring("excerpt", 1, 60)).orderBy(*order))
    kept = ranked.withColumn("share", share).withColumn("k", once).where((F.col("k") == 1) & (F.col("excerpt") != ""))
    return kept.orderBy(*order).limit(top).select("member", "id", F.col("share").alias("score"), "excerpt")


def episodic(rows: DataFrame, pivots: DataFrame, key: str, seq: str, ts: str, now: Column, before: int = 5, after: int = 5, horizon: int = 86_400) -> DataFrame:
    """(key, pivot, pivots, gamma, n_before, n_after, created, relevance) of the moments around pivots.

    ``pivots``: (key, seq, gamma).  Pivots of one episode share the moment of the earliest; the best gamma
    counts.  A row belongs if it is within ``before`` or ``after`` places and less than ``horizon`` seconds
    away.  A null key is no episode: such pivots are orphans, each its own moment at its own time.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    order = Window.partitionBy(key).orderBy(seq)
    own = rows.where(F.col(key).isNotNull()).join(pivots.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi").select(key, seq, at.alias("at"))
    framed = own.withColumn("past", F.collect_list("at").over(order.rowsBetween(-before, -1))).withColumn("next", F.collect_list("at").over(order.rowsBetween(1, after)))
    near = lambda c: F.filter(c, lambda x: F.abs(x - F.col("at")) < horizon * 1_000_000)
    framed = framed.select(key, seq, "at", near("past").alias("past"), near("next").alias("next"))
    groups = pivots.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(seq).alias(seq), F.count(F.lit(1)).alias("pivots"), F.max("gamma").alias("gamma"))
    held = groups.join(framed, [key, seq]).select(key, F.col(seq).alias("pivot"), "pivots", "gamma", F.size("past").alias("n_before"), F.size("next").alias("n_after"), F.coalesce(F.get("past", F.lit(0)), "at").alias("created"), F.lit(False).alias("orphan"))
    lone = pivots.where(F.col(key).isNull()).select(seq, "gamma").join(rows.where(F.col(key).isNull()).select(key, seq, at.alias("created")), seq)
    alone = lone.select(key, F.col(seq).alias("pivot"), F.lit(1).cast("long").alias("pivots"), "gamma", F.lit(0).alias("n_before"), F.lit(0).alias("n_after"), "created", F.lit(True).alias("orphan"))
    age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.col("created")) / 86_400e6)
    out = held.unionByName(alone).withColumn("relevance", relevance(F.col("gamma"), F.col("n_before") + F.col("n_after"), age, F.col("orphan")))
    return out.withColumn("created", F.timestamp_micros("created"))


def meditate(scored: DataFrame, age_days: str, top: int = 5, window_days: float | None = None, dormant_days: float | None = None, least: float = 0.0) -> DataFrame:
    """The best of (id, gamma, age): of four times as many candidates, those of the last days or, for ``dormant_days``,
    those quiet for as long; passages of unknown age only without either."""
    found = scored.where(F.col("gamma") > least).orderBy(F.desc("gamma"), "id").limit(4 * top)
    if dormant_days is not None:
        found = found.where(F.col(age_days) >= dormant_days)
    elif window_days is not None:
        found = found.where(F.col(age_days).isNotNull() & (F.greatest(F.lit(0.0), F.col(age_days)) <= window_days))
    return found.orderBy(F.desc("gamma"), "id").limit(top)


def fidelity(rows: DataFrame, key: str, text: str, cap: int = 32_768) -> DataFrame:
    """(key, parts, at_cap, complete): an episode is whole if no text has the length that texts are cut to."""
    full = F.count(F.when(F.length(text) >= cap, 1))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("parts"), full.alias("at_cap"), (full == 0).alias("complete"))


def keyword_snippets(docs: DataFrame, keywords: DataFrame, id_col: str = "doc_id", text_col: str = "text", before: int = 45, after: int = 95) -> DataFrame:
    """(member, keyword, id, snippet): for each keyword the passage of its member that has it as a word and most ache.

    ``docs``: (id, member, text, ache); of equal ache the last passage counts.  ``keywords``: (member,
    keyword).  Passages meet keywords by an equi-join on their distinct words, and only ids and ache are
    carried until one is chosen.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\x0b\f\r]+", " "))
    words = F.array_distinct(F.regexp_extract_all(F.lower(flat), F.lit("[a-z]{3,}"), F.lit(0)))
    said = docs.select(F.col(id_col).alias("id"), "member", F.coalesce("ache", F.lit(0.0)).alias("ache"), F.explode(words).alias("keyword"))
    best = said.join(keywords.select("member", "keyword"), ["member", "keyword"]).groupBy("member", "keyword").agg(F.max(F.struct("ache", "id"))["id"].alias("id"))
    joined = best.join(docs.select(F.col(id_col).alias("id"), flat.alias("flat")), "id")
    at = F.instr(F.lower("flat"), F.col("keyword"))
    start = F.greatest(F.lit(1), at - before)
    snippet = F.concat(F.when(start > 1, "...").otherwise(""), F.substring("flat", start, at + after - start))
    return joined.select("member", "keyword", "id", snippet.alias("snippet"))
