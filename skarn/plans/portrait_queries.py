"""Names, portraits and comparisons of corpora over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import lexicon as L
from skarn.functions import text as X
from skarn.operators import corpus, portrait, profile
from skarn.plans.corpus_queries import STATS, TOK, _lists
from skarn.plans.grammar_queries import ADDRESS, _signals_sql
from skarn.plans.profile_queries import _SEEDS
from skarn.plans.registry import query, table

_STOP = ", ".join(f"'{w}'" for w in L.VOCAB_STOPWORDS)
_NAMED = (
    f"WITH {ADDRESS}, w AS (SELECT address, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS word FROM documents JOIN addressed USING (doc_id)),"
    " u AS (SELECT address, word, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY 1, 2), g AS (SELECT word, sum(df) AS gdf FROM u GROUP BY word),"
    " n AS (SELECT address, count(*) AS n FROM addressed GROUP BY 1), t AS (SELECT count(*) AS total FROM documents),"
    f" r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY tf DESC, word) AS place FROM u JOIN g USING (word) JOIN n USING (address), t) WHERE word NOT IN ({_STOP})),"
    " a AS (SELECT address, word, 1 AS tier, round(tf / n * pow(ln((total + 1) / (gdf + 1)), 2) * sqrt(length(word)), 9) AS score FROM r WHERE df >= greatest(2, floor(n * 0.08))),"
    " b AS (SELECT address, word, 2 AS tier, tf * length(word) AS score FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY place) AS kept FROM r WHERE place <= 50) WHERE kept <= 10 AND address NOT IN (SELECT address FROM a)),"
    " c AS (SELECT address, word, 3 AS tier, tf AS score FROM r WHERE place <= 30), x AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),"
    " s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address, word[1:5] ORDER BY tier, score DESC, word) AS k FROM x) WHERE k = 1),"
    " f AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY tier, score DESC, word) AS rank FROM s)"
)


def _signals(spark, sf):
    rounded = F.transform(X.structural(F.col("text")), lambda x: F.round(x, 6))
    return table(spark, sf, "documents").select("doc_id", "text", rounded.alias("v"))


@query(f"{_NAMED} SELECT address, upper(string_agg(word, '_' ORDER BY rank)) AS name FROM f WHERE (tier < 3 AND rank <= 3) OR rank <= 2 GROUP BY address")
def a12_names(spark, sf):
    """Formations named by the words that tell them from the corpus."""
    filed = _signals(spark, sf).select(X.address(F.col("v")).alias("address"), "text")
    return portrait.names(filed, "address", "text")


_UNPIVOT = " UNION ALL ".join(f"SELECT doc_id, {k} AS place, '{d}' AS dimension, {d.lower()} AS x FROM sig" for k, d in enumerate(L.DIMENSIONS))


@query(
    f"WITH sig AS (SELECT doc_id, {_signals_sql()} FROM documents), e AS ({_UNPIVOT}), s AS (SELECT place, dimension, sum(x) AS total, arg_max(doc_id, (x, -doc_id)) AS strongest FROM e GROUP BY 1, 2),"
    " h AS (SELECT *, CASE WHEN sum(total) OVER () > 0 THEN total / sum(total) OVER () ELSE 0.0 END AS share FROM s)"
    " SELECT dimension, round(total, 4) AS total, round(share, 6) AS share, row_number() OVER (ORDER BY round(share, 9) DESC, place) AS rank, strongest, share <= 0 AS absent FROM h"
)
def a12_dimensions(spark, sf):
    """What a corpus does most, where it does so most clearly, and what it never does."""
    found = portrait.dimensions(_signals(spark, sf), "doc_id", "v", "text")
    return found.select("dimension", F.round("total", 4).alias("total"), F.round("share", 6).alias("share"), F.col("rank").cast("long").alias("rank"), "strongest", "absent")


# Two states of one corpus: its first half, and all of it.
_HALF = "(SELECT max(doc_id) // 2 FROM documents)"


def _halves(spark, sf):
    docs = table(spark, sf, "documents")
    half = docs.agg(F.floor(F.max("doc_id") / 2).alias("half"))
    return docs.join(F.broadcast(half), F.col("doc_id") <= F.col("half")).drop("half"), docs  # one row


@query(
    f"WITH {ADDRESS}, b AS (SELECT DISTINCT address FROM addressed WHERE doc_id <= {_HALF}), a AS (SELECT DISTINCT address FROM addressed),"
    f" j AS (SELECT count(*) FILTER (b.address IS NOT NULL AND a.address IS NOT NULL) AS stable, count(*) FILTER (b.address IS NULL) AS added, count(*) FILTER (a.address IS NULL) AS removed FROM b FULL JOIN a ON a.address = b.address)"
    f" SELECT stable, added, removed, round(stable / greatest(stable + added, stable + removed, 1), 6) AS stability, round((added + removed) / greatest(stable + added + removed, 1), 6) AS churn,"
    f" round((SELECT count(*) FROM documents) / (stable + added) - (SELECT count(*) FROM documents WHERE doc_id <= {_HALF}) / (stable + removed), 3) AS per_formation_change FROM j"
)
def a07_formation_changes(spark, sf):
    """What becomes of formations, and of passages a formation, as the corpus grows."""
    before, after = _halves(spark, sf)
    filed = lambda t: t.select(X.address(F.transform(X.structural(F.col("text")), lambda x: F.round(x, 6))).alias("address"))
    b, a = filed(before), filed(after)
    sizes = a.agg(F.count(F.lit(1)).alias("n1")).crossJoin(b.agg(F.count(F.lit(1)).alias("n0")))
    out = portrait.compare(b, a, "address").crossJoin(F.broadcast(sizes))
    change = F.col("n1") / (F.col("stable") + F.col("added")) - F.col("n0") / (F.col("stable") + F.col("removed"))
    return out.select("stable", "added", "removed", F.round("stability", 6).alias("stability"), F.round("churn", 6).alias("churn"), F.round(change, 3).alias("per_formation_change"))


_RANKED = (
    f"{TOK}, c0 AS (SELECT term, count(*) AS cf FROM tok WHERE id <= {_HALF} GROUP BY term), c1 AS (SELECT term, count(*) AS cf FROM tok GROUP BY term),"
    " r0 AS (SELECT term, row_number() OVER (ORDER BY cf DESC, term) AS old FROM c0 QUALIFY old <= 200), r1 AS (SELECT term, row_number() OVER (ORDER BY cf DESC, term) AS new FROM c1 QUALIFY new <= 200),"
    " m AS (SELECT greatest((SELECT count(*) FROM r0), (SELECT count(*) FROM r1)) + 1 AS last),"
    " drift AS (SELECT term, coalesce(old, last) - coalesce(new, last) AS change FROM r0 FULL JOIN r1 USING (term), m WHERE abs(coalesce(old, last) - coalesce(new, last)) >= 5 ORDER BY abs(change) DESC, term LIMIT 50)"
)


def _drift(spark, sf):
    before, after = (corpus.token_stats(corpus.token_lists(t)) for t in _halves(spark, sf))
    return portrait.rank_drift(before, after)


@query(f"WITH {_RANKED} SELECT term, change FROM drift")
def a05_rank_drift(spark, sf):
    """Terms whose rank moves by five places and more as the corpus grows."""
    return _drift(spark, sf)


@query(
    f"WITH {_RANKED}, {_SEEDS}, p AS (SELECT dimension, count(cf) / count(*) AS share FROM seeds LEFT JOIN c1 USING (term) GROUP BY dimension),"
    " b AS (SELECT term, dimension, change, CASE WHEN share < 0.2 THEN 3.0 WHEN share > 0.8 THEN 1.5 ELSE 2.0 END AS w FROM seeds JOIN p USING (dimension) LEFT JOIN drift USING (term))"
    " SELECT term, dimension, (CASE WHEN change < -10 THEN least(w + 0.5, 3.0) ELSE w END)::DOUBLE AS weight FROM b"
)
def a05_recommended_weights(spark, sf):
    """Seed weights for the next cycle."""
    return portrait.recommend(profile.presence(_lists(spark, sf)), _drift(spark, sf))


_SIZES = "CASE dimension " + " ".join(f"WHEN '{d}' THEN {len(t) - 1}" for d, t in L.SEEDS.items()) + " END"


@query(
    f"WITH {TOK}, {_SEEDS}, near AS (SELECT a.term AS seed, b.term AS word, count(*) AS n FROM tok a JOIN seeds s ON s.term = a.term JOIN tok b ON a.id = b.id AND b.pos BETWEEN a.pos - 10 AND a.pos + 10"
    f" WHERE b.term <> a.term AND length(b.term) >= 3 AND b.term NOT IN ({_STOP}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY n DESC, word) AS k FROM near),"
    " u AS (SELECT term, count(*) AS uses FROM tok GROUP BY term), m AS (SELECT seed, s.dimension, count(*) FILTER (x.dimension = s.dimension) AS met FROM r JOIN seeds s ON s.term = seed LEFT JOIN seeds x ON x.term = word WHERE k <= 15 GROUP BY 1, 2)"
    f" SELECT seed AS term, dimension, round(met / ({_SIZES}), 6) AS overlap, round(1 - met / ({_SIZES}), 6) AS severity, uses FROM m JOIN u ON u.term = seed WHERE uses >= 3 AND met / ({_SIZES}) < 0.5"
)
def a02_misread(spark, sf):
    """Seed terms that keep other company than their dimension's."""
    found = portrait.misread(_lists(spark, sf))
    return found.select("term", "dimension", F.round("overlap", 6).alias("overlap"), F.round("severity", 6).alias("severity"), "uses")


@query(
    "WITH p AS (SELECT count(*) AS passages FROM (SELECT unnest(regexp_split_to_array(text, '\\n[ \\t\\n\\x0b\\f\\r]*\\n')) AS c FROM documents) WHERE length(trim(c, E' \\t\\n\\x0b\\f\\r')) > 20)"
    " SELECT (SELECT count(*) FROM documents) AS documents, passages, round(ln((SELECT count(*) FROM documents) + 1) / ln(passages + 1), 6) AS r FROM p"
)
def a06_compression(spark, sf):
    """The other growth measure: logarithms of documents and of the passages they came to."""
    docs = table(spark, sf, "documents")
    parts = docs.select(F.explode(X.paragraphs(F.col("text")))).agg(F.count(F.lit(1)).alias("passages"))
    out = docs.agg(F.count(F.lit(1)).alias("documents")).crossJoin(parts)
    return out.withColumn("r", F.round(F.log(F.col("documents") + 1.0) / F.log(F.col("passages") + 1.0), 6))
