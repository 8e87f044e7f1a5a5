"""Chunking, tokenisation, corpus statistics and passage vectors over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.core.durable import cut
from skarn.functions import lexicon as L
from skarn.functions import text as X
from skarn.operators import corpus
from skarn.plans.registry import query, table

VOCAB = 24
SPACE = r"[ \t\n\x0b\f\r]"

# Shared pieces of the SQL equivalents.
LISTS = "lists AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z]+') AS words FROM documents)"
TOK = LISTS + ", tok AS (SELECT id, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM lists)"
STATS = TOK + (
    ", stats AS (SELECT term, count(*) AS cf, count(DISTINCT id) AS df, max(id) AS last_id FROM tok GROUP BY term)"
    ", totals AS (SELECT count(DISTINCT id) AS doc_count, count(*) AS token_mass FROM tok)"
)
PAIRS = STATS + (
    ", pairs AS (SELECT least(a.term, b.term) AS t1, greatest(a.term, b.term) AS t2, count(*) AS n FROM tok a JOIN tok b"
    " ON a.id = b.id AND b.pos BETWEEN a.pos + 1 AND a.pos + 9 AND a.term <> b.term GROUP BY 1, 2)"
    ", mass AS (SELECT sum(n) AS pair_mass FROM pairs)"
)
PMI = PAIRS + (
    ", pmis AS (SELECT t1, t2, n, log2((n / pair_mass) / ((x.cf / token_mass) * (y.cf / token_mass))) AS pmi"
    " FROM pairs JOIN stats x ON x.term = t1 JOIN stats y ON y.term = t2, totals, mass)"
)
_STOP = ", ".join(f"'{w}'" for w in L.VOCAB_STOPWORDS)
_SEEDED = ", ".join(f"'{w}'" for terms in L.SEEDS.values() for w in terms)


def vocab_sql(where: str, score: str, size: int) -> str:
    return (
        f", scored AS (SELECT term, {score} * CASE WHEN term IN ({_SEEDED}) THEN 2.0 ELSE 1.0 END AS score FROM stats, totals"
        f" WHERE length(term) >= 3 AND {where})"
        f", vocab AS (SELECT row_number() OVER (ORDER BY score DESC, term) AS pos, term, score FROM scored ORDER BY score DESC, term LIMIT {size})"
    )


HIGH = vocab_sql(f"term NOT IN ({_STOP}) AND df <= 0.5 * doc_count AND log2(doc_count / df) >= 1.0", "log2(doc_count / df) * log2(doc_count / df) * log2(cf + 1.0)", VOCAB)
LINKS = ", links AS (SELECT p.term, v.pos, p.value FROM (SELECT t1 AS term, t2 AS v, pmi AS value FROM pmis UNION ALL SELECT t2, t1, pmi FROM pmis) p JOIN vocab v ON v.term = p.v WHERE p.value <> 0)"
SEED_WEIGHTS = {t: 2.0 for terms in L.SEEDS.values() for t in terms}


def _lists(spark, sf):
    return corpus.token_lists(table(spark, sf, "documents"))


def _model(spark, sf):
    """lists, stats, totals, vocab and links over the documents."""
    lists = cut(_lists(spark, sf))  # words are read off the texts once
    return lists, *corpus.learn(lists, VOCAB, seeds=SEED_WEIGHTS)


@query(
    "SELECT doc_id, u.position, u.chunk FROM (SELECT doc_id, unnest(list_transform(list_zip(p, range(len(p))), lambda x: {'position': x[2], 'chunk': trim(x[1], E' \\t\\n\\x0b\\f\\r')})) AS u"
    r" FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t\n\x0b\f\r]*\n') AS p FROM documents)) WHERE length(u.chunk) > 20"
)
def c01_paragraphs(spark, sf):
    docs = table(spark, sf, "documents")
    parts = docs.select("doc_id", F.explode(X.paragraphs(F.col("text"))).alias("p"))
    return parts.select("doc_id", F.col("p.position").cast("long").alias("position"), F.col("p.chunk").alias("chunk"))


@query("SELECT doc_id, md5(substr(text, 1, 32768)) AS capped_md5, length(text) > 32768 AS was_capped FROM documents")
def c03_text_cap(spark, sf):
    text, longer = X.capped(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", X.content_hash(text).alias("capped_md5"), longer.alias("was_capped"))


@query(
    r"SELECT sum((n > 10)::INT)::BIGINT AS learnable, sum((n >= 10)::INT)::BIGINT AS storable, sum((n >= 30)::INT)::BIGINT AS heard FROM"
    r" (SELECT length(regexp_replace(text, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')) AS n FROM documents)"
)
def c04_length_gates(spark, sf):
    n = F.length(X.strip(F.col("text")))
    return table(spark, sf, "documents").agg(*(F.sum(x.cast("long")).alias(a) for x, a in ((n > 10, "learnable"), (n >= 10, "storable"), (n >= 30, "heard"))))


@query(f"WITH {TOK} SELECT term, count(*) AS n FROM tok GROUP BY term")
def t01_tokens(spark, sf):
    return _lists(spark, sf).select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STATS} SELECT term, cf, df, last_id FROM stats")
def t02_term_stats(spark, sf):
    return corpus.token_stats(_lists(spark, sf)).select("term", F.col("cf").cast("long").alias("cf"), "df", "last_id")


@query(f"WITH {PAIRS} SELECT t1, t2, n FROM pairs")
def t03_pair_counts(spark, sf):
    return corpus.pair_stats(_lists(spark, sf))


@query(f"WITH {PMI} SELECT t1, t2, n, round(pmi, 6) AS pmi FROM pmis")
def t04_pmi(spark, sf):
    return corpus.every_pmi(_lists(spark, sf))[0].select("t1", "t2", "n", corpus.rounded(F.col("pmi"), 6).alias("pmi"))


@query(f"WITH {STATS} SELECT term, round(pow(0.5, ((SELECT max(id) FROM tok) - last_id) / 500.0), 6) AS recency FROM stats")
def t05_recency(spark, sf):
    stats = corpus.token_stats(_lists(spark, sf))
    newest = stats.agg(F.max("last_id").alias("newest"))
    return stats.crossJoin(F.broadcast(newest)).select("term", F.round(corpus.recency(F.col("newest") - F.col("last_id"), 500.0), 6).alias("recency"))


def _vocab(spark, sf, d, size=200):
    lists = _lists(spark, sf)
    found = corpus.vocabulary(corpus.token_stats(lists), corpus.corpus_stats(lists), size, d=d, seeds=SEED_WEIGHTS)
    return found.select(F.col("pos").cast("long").alias("pos"), "term", F.round("score", 5).alias("score"))


@query(f"WITH {STATS}{HIGH.replace(f'LIMIT {VOCAB}', 'LIMIT 200')} SELECT pos, term, round(score, 5) AS score FROM vocab")
def t06_vocabulary(spark, sf):
    return _vocab(spark, sf, 6.0)


@query(f"WITH {STATS}{vocab_sql(f'term NOT IN ({_STOP})', '(0.6 * cf + 0.4 * log2(doc_count / df) * cf)', 200)} SELECT pos, term, round(score, 5) AS score FROM vocab")
def t06_vocabulary_blend(spark, sf):
    return _vocab(spark, sf, 4.0)


@query(f"WITH {STATS}{vocab_sql('df >= 0.1 * doc_count', '(cf * cf)::DOUBLE', 200)} SELECT pos, term, round(score, 5) AS score FROM vocab")
def t06_vocabulary_warm(spark, sf):
    return _vocab(spark, sf, 1.5)


_FADING = HIGH.replace(f"LIMIT {VOCAB}", "LIMIT 200").replace("log2(cf + 1.0)", "log2(cf + 1.0) * pow(0.5, ((SELECT max(last_id) FROM stats) - last_id) / 50.0)")


@query(f"WITH {STATS}{_FADING} SELECT pos, term, round(score, 5) AS score FROM vocab")
def t05_fading_vocabulary(spark, sf):
    """The vocabulary when a term's score halves for every 50 passages since it was last used."""
    lists = _lists(spark, sf)
    found = corpus.vocabulary(corpus.token_stats(lists), corpus.corpus_stats(lists), 200, seeds=SEED_WEIGHTS, half_life=50.0)
    return found.select(F.col("pos").cast("long").alias("pos"), "term", F.round("score", 5).alias("score"))


@query(
    f"WITH {STATS}{vocab_sql('df >= 0.1 * doc_count', '(cf * cf)::DOUBLE', 40)}, old AS (SELECT pos, term FROM vocab), "
    + vocab_sql(f"term NOT IN ({_STOP})", "(0.6 * cf + 0.4 * log2(doc_count / df) * cf)", 40)[2:].replace("scored", "scored2").replace("vocab AS", "fresh AS")
    + " SELECT pos, term FROM old UNION ALL SELECT (SELECT max(pos) FROM old) + row_number() OVER (ORDER BY pos), term FROM fresh WHERE term NOT IN (SELECT term FROM old)"
)
def t07_living_vocabulary(spark, sf):
    lists = _lists(spark, sf)
    stats, totals = corpus.token_stats(lists), corpus.corpus_stats(lists)
    old, fresh = (corpus.vocabulary(stats, totals, 40, d=d, seeds=SEED_WEIGHTS) for d in (1.5, 4.0))
    return corpus.extended(old, fresh).select(F.col("pos").cast("long").alias("pos"), "term")


@query(
    f"WITH {PMI}{HIGH}{LINKS}, w AS (SELECT DISTINCT id, term FROM tok) SELECT id AS doc_id, pos, round(avg(value), 6) AS value FROM w JOIN links USING (term) GROUP BY 1, 2"
)
def t09_mi_vectors(spark, sf):
    lists, _, _, vocab, links = _model(spark, sf)
    return corpus.vectors(lists, vocab, links).select(F.col("id").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(f"WITH {STATS}, w AS (SELECT DISTINCT id, term FROM tok) SELECT id AS doc_id, round(avg(log2(doc_count / df)), 6) AS ache FROM w JOIN stats USING (term), totals GROUP BY id")
def t10_ache(spark, sf):
    lists = _lists(spark, sf)
    return corpus.surprise(lists, corpus.token_stats(lists), corpus.corpus_stats(lists)).select(F.col("id").alias("doc_id"), F.round("ache", 6).alias("ache"))


@query(
    f"WITH {PMI}{HIGH}{LINKS}, w AS (SELECT DISTINCT id, term FROM tok), a AS (SELECT id, avg(log2(doc_count / df)) AS ache FROM w JOIN stats USING (term), totals GROUP BY id)"
    " SELECT id AS doc_id, pos, round(avg(value) * any_value(ache), 5) AS value FROM w JOIN links USING (term) JOIN a USING (id) GROUP BY 1, 2"
)
def t11_mi_ache_vectors(spark, sf):
    lists, stats, totals, vocab, links = _model(spark, sf)
    ache = corpus.surprise(lists, stats, totals)
    joined = corpus.vectors(lists, vocab, links).join(ache, "id")
    return joined.select(F.col("id").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.round(F.col("value") * F.col("ache"), 5).alias("value"))


@query(
    f"WITH {PMI}{HIGH}{LINKS}, w AS (SELECT DISTINCT id, term FROM tok), s AS (SELECT term, sum(abs(value)) AS strength FROM links GROUP BY term),"
    " k AS (SELECT id, term, log2(doc_count / df) * strength AS score FROM w JOIN stats USING (term) JOIN s USING (term), totals WHERE length(term) >= 3 AND df <= 0.5 * doc_count),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, term) AS rank FROM k WHERE score > 0)"
    " SELECT id AS doc_id, rank, term, round(score, 5) AS score FROM r WHERE rank <= 5"
)
def t12_keywords(spark, sf):
    lists, stats, totals, _, links = _model(spark, sf)
    return corpus.keywords(lists, stats, totals, links).select(F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "term", F.round("score", 5).alias("score"))


@query(f"WITH {PMI} SELECT t1, t2, n FROM (SELECT t1, t2, n, round(n / pair_mass * pmi, 12) AS gain FROM pmis, mass) ORDER BY gain DESC, t1, t2 LIMIT 1000")
def t13_retained_pairs(spark, sf):
    return corpus.retained_pairs(*corpus.every_pmi(_lists(spark, sf)), 1000).select("t1", "t2", "n")


@query("SELECT md5(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")
def t16_content_hash(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("hash"))
    return docs.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))


@query(
    r"SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(text, '^\[[0-9]{4}-[0-9]{2}-[0-9]{2}T[^\]\n]*\][^\n]*\n', '')), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS norm_md5 FROM documents"
)
def t17_normalised(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.content_hash(X.normalised(F.col("text"))).alias("norm_md5"))


@query("SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def j13_skip_duplicates(spark, sf):
    """Rows whose text an earlier row has are skipped; the join is on hashes, not on texts."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    hashed = docs.select("doc_id", X.content_hash(F.col("text")).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min("doc_id").alias("first_id"))
    later = hashed.join(first, "hash").where("doc_id > first_id").select("doc_id")
    return docs.join(later, "doc_id", "left_anti")


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS text_md5 FROM pages")
def s12_markup_stripped(spark, sf):
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), SPACE + "+", " "))
    return table(spark, sf, "pages").select("page_id", X.content_hash(plain).alias("text_md5"))


@query()
def s07_html_paragraphs(spark, sf):
    """Paragraphs of pages without markup, scripts and styles; headings keep a mark."""
    from skarn.sources.readers import html_text

    pages = table(spark, sf, "pages").select("page_id", html_text(F.col("html")).alias("text"))
    parts = pages.select("page_id", F.explode(X.paragraphs(F.col("text"))).alias("p"))
    return parts.select("page_id", F.col("p.position").cast("long").alias("position"), F.col("p.chunk").alias("chunk"))


@query()
def c02_bounded_chunks(spark, sf):
    """Paragraphs cut at 4,000 characters at the best boundary and merged greedily."""
    from skarn.sources.readers import bounded_chunks

    docs = table(spark, sf, "documents")
    parts = docs.select("doc_id", F.posexplode(bounded_chunks(F.col("text"))).alias("position", "chunk"))
    return parts.select("doc_id", F.col("position").cast("long").alias("position"), "chunk")
