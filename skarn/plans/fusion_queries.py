"""Rebuilds, filing and fusion over ``embeddings`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.core.durable import cut
from skarn.functions import text as X
from skarn.operators import coupling, formations, fusion
from skarn.plans.coupling_queries import _AGG, _CHAINED, _EDGES, THETA, _chained, _edges, _members, _vectors
from skarn.plans.registry import query, table


@query(
    f"WITH {_EDGES}, stored AS (SELECT * FROM edges WHERE dst < (SELECT count(*) * 4 // 5 FROM embeddings)), s AS (SELECT max(dst) + 1 AS start FROM stored)"
    " SELECT src, dst, round(gamma, 4) AS gamma, 'kept' AS step FROM stored UNION ALL SELECT src, dst, round(gamma, 4), 'appended' FROM edges, s WHERE dst >= start"
)
def f08_rebuild(spark, sf):
    """Couplings after the last fifth of the rows was appended."""
    start = table(spark, sf, "embeddings").count() * 4 // 5
    stored = cut(_edges(spark, sf).where(F.col("dst") < start))
    return coupling.rebuild(_vectors(spark, sf), "vec_id", "v", THETA, stored)[1].select("src", "dst", F.round("gamma", 4).alias("gamma"), "step")


@query(f"{_AGG} SELECT address, size, minds, round(mean_ache, 5) AS mean_ache, representative, round(amplitude, 6) AS amplitude, trust::DOUBLE AS trust, round(diversity, 6) AS diversity, round(score, 5) AS score FROM scored")
def f01_filing(spark, sf):
    """Formations kept up by filing: passages arrive in two parts, and their states are merged."""
    members = cut(_members(spark, sf))
    half = members.agg(F.floor(F.max("id") / 2).alias("half"))
    parts = members.join(F.broadcast(half), F.lit(True))  # one row
    states = [cut(formations.filed(parts.where(w))) for w in ("id <= half", "id > half")]
    f = formations.from_files(formations.merged_files(*states))
    return f.select("address", "size", "minds", F.round("mean_ache", 5).alias("mean_ache"), "representative", F.round("amplitude", 6).alias("amplitude"), "trust", F.round("diversity", 6).alias("diversity"), F.round("score", 5).alias("score"))


@query()
def f18_fusion(spark, sf):
    """Levels until the partition of the texts stays."""
    levels = fusion.fuse(table(spark, sf, "documents"), size=60)
    shared = len(fusion.core(levels))
    rows = [(k, x.d, x.epochs, x.formations, x.nmi, len(x.vocabulary), shared) for k, x in enumerate(levels)]
    return spark.createDataFrame(rows, "level int, d double, epochs int, formations long, nmi double, terms int, core int")


_FP = r"lower(regexp_replace(substr(text, 1, 80), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g'))"


@query(
    f"WITH d AS (SELECT doc_id, lang, {_FP} AS fp FROM documents), a AS (SELECT fp, arg_max(lang, doc_id) AS lang FROM d GROUP BY fp),"
    " b AS (SELECT fp, arg_max(quality, doc_id) AS quality FROM d JOIN labels USING (doc_id) GROUP BY fp) SELECT fp, lang, quality FROM a JOIN b USING (fp)"
)
def j12_fingerprints(spark, sf):
    """Texts that two partitions label, met by fingerprint."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.lower(X.strip(F.substring("text", 1, 80))).alias("fp"))
    a = docs.groupBy("fp").agg(F.max_by("lang", "doc_id").alias("lang"))
    b = docs.join(table(spark, sf, "labels"), "doc_id").groupBy("fp").agg(F.max_by("quality", "doc_id").alias("quality"))
    return a.join(b, "fp")


_CENTROID = ", ".join(f"round(coalesce(avg(CASE WHEN live THEN h[{k}] END), 0), 6) AS c{k - 1}" for k in range(1, 9))


@query(
    f"WITH {_EDGES}, {_CHAINED}, g2 AS (SELECT id, round(sum(gamma), 6) AS strength FROM (SELECT src AS id, gamma FROM edges UNION ALL SELECT dst, gamma FROM edges) GROUP BY id),"
    " m AS (SELECT coalesce(chain[1], 'NONE') AS address, vec_id AS id, chains, list_slice(v, 1, 8) AS h, list_contains(active, 'AI') AS self, coalesce(strength, 0.0) AS strength, len(list_filter(list_slice(v, 1, 8), lambda x: x > 0)) > 0 AS live FROM rows JOIN c0 USING (vec_id) LEFT JOIN g2 ON g2.id = vec_id),"
    f" a AS (SELECT address, count(*) AS size, round(avg(self::INT), 2) AS self_share, arg_max(id, (strength, -id)) AS representative, {_CENTROID} FROM m GROUP BY address),"
    " n AS (SELECT address, chain, count(*) AS n FROM (SELECT address, unnest(chains) AS chain FROM m) GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY n DESC, chain) AS place FROM n),"
    " t AS (SELECT address, string_agg(chain, ' ' ORDER BY place) AS top_chains FROM b WHERE place <= 5 GROUP BY address) SELECT a.*, top_chains FROM a LEFT JOIN t USING (address)"
)
def f05_cognitive(spark, sf):
    """Chains, centroid, self-reference and representative of rows grouped by the dimension that leads their chain."""
    rows = _chained(spark, sf)
    first = F.transform(F.slice("v", 1, 8), lambda x: F.round(x.cast("double"), 6))
    members = rows.select(F.coalesce(F.get("pathway.chain", F.lit(0)), F.lit("NONE")).alias("address"), F.col("vec_id").alias("id"), "chains", first.alias("vector"), F.array_contains("pathway.active", "AI").alias("self_referential"))
    found = formations.cognitive(members, _edges(spark, sf))
    places = lambda x: F.round(x * 1e6) / 1e6  # noqa: E731  as SQL rounds: the product, not the decimal digits
    return found.select("address", "size", "self_share", "representative", *(places(F.col("centroid")[k]).alias(f"c{k}") for k in range(8)), F.array_join("top_chains", " ").alias("top_chains"))
