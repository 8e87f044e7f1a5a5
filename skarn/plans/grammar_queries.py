"""Scalar grammar functions over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions import grammar as G
from skarn.functions import lexicon as L
from skarn.functions import text as X
from skarn.plans.corpus_queries import TOK, _lists
from skarn.plans.registry import query, table


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_ENDS = lambda s: "regexp_matches(term, '(" + "|".join(s) + ")$')"


@query(
    f"WITH {TOK}, w AS (SELECT term, count(*) AS n FROM tok GROUP BY term) SELECT CASE WHEN term IN {_in(L.GRAMMAR_STOPWORDS)} THEN 'stop' WHEN term IN {_in(L.AUXILIARIES)} THEN 'aux'"
    f" WHEN term IN {_in(L.SELF_PRONOUNS)} THEN 'pron_self' WHEN term IN {_in(L.OTHER_PRONOUNS)} THEN 'pron_other' WHEN term IN {_in(L.RELATIONAL)} THEN 'prep_rel'"
    f" WHEN term LIKE '%ly' AND length(term) > 5 THEN 'adv' WHEN length(term) > 4 AND {_ENDS(L.VERB_SUFFIXES)} THEN 'verb' WHEN length(term) > 4 AND {_ENDS(L.NOUN_SUFFIXES)} THEN 'noun'"
    f" WHEN length(term) > 4 AND {_ENDS(L.ADJECTIVE_SUFFIXES)} THEN 'adj' ELSE 'unknown' END AS part, count(*) AS words, sum(n)::BIGINT AS uses FROM w GROUP BY 1"
)
def g02_parts_of_speech(spark, sf):
    """Classes of distinct words: the guess runs once per word, not once per use."""
    words = _lists(spark, sf).select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy(X.part_of_speech(F.col("term")).alias("part")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("uses"))


@query()
def g05_parse(spark, sf):
    parsed = table(spark, sf, "documents").select("doc_id", G.parser()(F.col("text")).alias("p"))
    vector = [F.round(F.col("p.vector")[k], 6).alias(d.lower()) for k, d in enumerate(L.DIMENSIONS)]
    return parsed.select("doc_id", *vector, F.array_join("p.chains", " ").alias("chains"))


#: RE2 knows ASCII word boundaries only: other letters are made plain ones first.
_TEXT = r"regexp_replace(text, '[^\P{L}a-zA-Z]', 'x', 'g')"
_COUNTS = {k: f"len(regexp_extract_all({_TEXT}, '" + p.replace("'", "''").replace(r"\x0b", r"\x0B") + "'))" for k, p in L.STRUCTURE.items()}


def _signals_sql() -> str:
    sums = {d: ["0.0::DOUBLE"] for d in L.DIMENSIONS}
    for d, names, weight, most in L.SIGNALS:
        sums[d].append(f"least({most}::DOUBLE, ({' + '.join(_COUNTS[x] for x in names)}) * {weight}::DOUBLE)")
    return ", ".join(f"round({' + '.join(v)}, 6) AS {d.lower()}" for d, v in sums.items())


@query(f"SELECT doc_id, {_signals_sql()} FROM documents")
def g10_structural_signals(spark, sf):
    signals = table(spark, sf, "documents").select("doc_id", X.structural(F.col("text")).alias("s"))
    return signals.select("doc_id", *(F.round(F.col("s")[k], 6).alias(d.lower()) for k, d in enumerate(L.DIMENSIONS)))


def _digest(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", G.parser()(F.col("text")).alias("p"), X.structural(F.col("text")).alias("s"))
    return docs.withColumn("a", G.activation(F.col("p.vector"), F.col("s")))


@query()
def g11_activation(spark, sf):
    return _digest(spark, sf).select("doc_id", *(F.round(F.col("a")[k], 6).alias(d.lower()) for k, d in enumerate(L.DIMENSIONS)))


@query(
    "SELECT doc_id, unnest(list_transform(s, lambda x: round(CASE WHEN t = 0 THEN 0.125 ELSE 1.0 - x / t END, 6))) AS ache, generate_subscripts(s, 1) AS place FROM (SELECT doc_id, s, list_sum(s) AS t FROM"
    f" (SELECT doc_id, [ko, te, sf, cr, ic, de, ew, ai] AS s FROM (SELECT doc_id, {_signals_sql()} FROM documents)))"
)
def g13_conservation(spark, sf):
    signals = table(spark, sf, "documents").select("doc_id", F.transform(X.structural(F.col("text")), lambda x: F.round(x, 6)).alias("s"))
    ache = signals.select("doc_id", F.posexplode(X.conservation(F.col("s"))).alias("place", "ache"))
    return ache.select("doc_id", F.round("ache", 6).alias("ache"), (F.col("place") + 1).cast("long").alias("place"))


@query()
def g18_digest(spark, sf):
    """Activation, residual, first chain and glyph of every passage."""
    d = _digest(spark, sf).withColumn("chain", G.first_chain(F.col("p.chains"), F.col("a")))
    names = F.array(*map(F.lit, L.DIMENSIONS))
    dominant = F.element_at(names, F.array_position(F.col("a"), F.array_max("a")).cast("int"))
    return d.select("doc_id", F.array_join("chain", ">").alias("chain"), dominant.alias("dominant"), X.glyph(dominant, F.col("chain"), F.col("text")).alias("glyph"))


def _address_sql(source: str) -> str:
    labels = "[" + ", ".join(f"'{x.upper()}'" for x in L.LABELS) + "]"
    return (
        f"dims AS (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM ({source})),"
        " ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x DESC, place) AS k FROM dims WHERE x > 0.01),"
        f" named AS (SELECT doc_id, max(CASE WHEN k = 1 THEN {labels}[place] END) AS a, max(CASE WHEN k = 2 THEN {labels}[place] END) AS b, max(CASE WHEN k = 3 THEN {labels}[place] END) AS c FROM ranked WHERE k <= 3 GROUP BY doc_id),"
        " addressed AS (SELECT d.doc_id, CASE WHEN a IS NULL THEN 'UNKNOWN' ELSE a || coalesce('+' || b, '') || coalesce('_via_' || c, '') END AS address FROM documents d LEFT JOIN named n ON n.doc_id = d.doc_id)"
    )


ADDRESS = _address_sql(f"SELECT doc_id, [ko, te, sf, cr, ic, de, ew, ai] AS v FROM (SELECT doc_id, {_signals_sql()} FROM documents)")


@query(f"WITH {ADDRESS} SELECT doc_id, address FROM addressed")
def g22_address(spark, sf):
    signals = table(spark, sf, "documents").select("doc_id", F.transform(X.structural(F.col("text")), lambda x: F.round(x, 6)).alias("v"))
    return signals.select("doc_id", X.address(F.col("v")).alias("address"))


@query(
    "WITH p AS (SELECT conv_id, turn, text AS u, lead(text) OVER w AS a, role, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),"
    " s AS (SELECT conv_id, turn, CASE WHEN regexp_matches(u || chr(10) || chr(10) || a, '(?i)" + "|".join(L.DOCTRINE).replace("'", "''") + "') THEN 2.0 ELSE 0.0 END"
    " + CASE WHEN length(a) > 1000 THEN 0.5 ELSE 0.0 END + CASE WHEN contains(lower(u || chr(10) || chr(10) || a), 'tion') THEN 1.0 ELSE 0.0 END AS score FROM p WHERE role = 'user' AND r = 'assistant')"
    " SELECT conv_id, turn, score::DOUBLE AS score, score >= 1.5 AS deposit FROM s"
)
def g23_deposits(spark, sf):
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf, "conversations")
    paired = turns.withColumn("answer", F.lead("text").over(order)).withColumn("next_role", F.lead("role").over(order))
    score, keep = X.deposit_score(F.col("text"), F.col("answer"), high_value=("tion",))
    return paired.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", score.alias("score"), keep.alias("deposit"))


TAGS = {"asking": [r"\?", "how"], "doing": ["build", "test"], "saying": [r"\.\s*$"]}
_TAGGED = " ".join(f"WHEN regexp_matches(u || chr(10) || chr(10) || a, '(?i){'|'.join(f'(?:{p})' for p in patterns)}') THEN '{tag}'" for tag, patterns in reversed(TAGS.items()))


@query(
    "WITH p AS (SELECT conv_id, turn, text AS u, lead(text) OVER w AS a, role, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
    f" SELECT conv_id, turn, CASE {_TAGGED} ELSE 'ambient' END AS tag FROM p WHERE role = 'user' AND r = 'assistant'"
)
def g23_routing_tags(spark, sf):
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf, "conversations")
    paired = turns.withColumn("answer", F.lead("text").over(order)).withColumn("next_role", F.lead("role").over(order))
    tag = X.routing_tag(F.col("text"), F.col("answer"), TAGS)
    return paired.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", tag.alias("tag"))


@query(
    r"WITH h AS (SELECT doc_id, substr(regexp_replace(text, '^[ \t\n\x0b\f\r]+', ''), 1, 200) AS head FROM documents),"
    r" w AS (SELECT doc_id, head, list_filter(regexp_split_to_array(head, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM h)"
    " SELECT doc_id, len(ws) > 0 AND length(head) - length(translate(head, '{}[]\":`=', '')) <= 8"
    r" AND len(list_filter(ws, lambda x: length(regexp_replace(x, '[^\p{L}]', '', 'g')) >= length(x) * 0.6)) >= len(ws) * 0.6 AS prose FROM w"
)
def g24_prose(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.is_prose(F.col("text")).alias("prose"))


_LOW = {k: ", ".join(f"'{w}'" for w in v) for k, v in L.MODIFIERS.items()}
_SHARE = {k: f"len(list_filter(ws, lambda x: lower(x) IN ({v}))) / n" for k, v in _LOW.items()}


@query(
    "WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[a-zA-Z]+') AS ws FROM documents), c AS (SELECT *, greatest(len(ws), 1)::DOUBLE AS n,"
    " length(text) - length(replace(text, ',', '')) AS commas, len(list_filter(ws[2:], lambda x: regexp_matches(x, '^[A-Z]') AND length(x) > 1)) AS middle,"
    " len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]{2,}$'))) AS capitals FROM w),"
    " r AS (SELECT doc_id, count(*) AS repeated FROM (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, lower(unnest(ws)) AS x FROM w) WHERE length(x) > 2 GROUP BY 1, 2) WHERE k >= 3 GROUP BY doc_id)"
    f" SELECT c.doc_id, round(least(1.0, {_SHARE['depth']} + least(n / 50, 0.5)), 6) AS depth, round(least(1.0, {_SHARE['scope']} + least(commas / greatest(n / 5, 1.0), 0.5)), 6) AS scope,"
    f" round(least(1.0, {_SHARE['focus']} + least(middle / n, 0.3)), 6) AS focus, round(least(1.0, {_SHARE['flex']}), 6) AS flex,"
    " round(least(1.0, CASE WHEN contains(text, '!') THEN 0.3 ELSE 0.0 END + least(capitals / n, 0.4) + least(coalesce(repeated, 0) * 0.15, 0.3)), 6) AS urgent"
    " FROM c LEFT JOIN r ON r.doc_id = c.doc_id WHERE len(ws) > 0"
)
def g07_modifiers(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("text").rlike("[a-zA-Z]"))
    return docs.select("doc_id", *(F.round(v, 6).alias(k) for k, v in X.modifiers(F.col("text")).items()))


@query()
def a13_fingerprint(spark, sf):
    """The most used chains and their shares."""
    from skarn.operators import profile

    return profile.fingerprint(g18_digest(spark, sf), "chain")


@query()
def a11_emergence(spark, sf):
    """Novelty and phase of each member's passages, by the dimensions of their chains."""
    from skarn.operators import profile

    members = g18_digest(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    members = members.where("chain <> ''").withColumn("operations", F.split("chain", ">"))
    return profile.emergence(members, "source", "operations", "dominant", previous=["CR", "EW"])


@query()
def a11_collective(spark, sf):
    """How far the members' new operations are shared among them."""
    from skarn.operators import profile

    members = g18_digest(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return profile.collective(members.where("chain <> ''").withColumn("operations", F.split("chain", ">")), "source", "operations", known=["CR", "EW"])


_D = {d: f"v[{k}]" for k, d in enumerate(L.DIMENSIONS, 1)}
_BASINS = ", ".join("0.0::DOUBLE + " + " + ".join(f"{_D[d]} * {w}::DOUBLE" for d, w in weights.items()) + f" AS {name.lower()}" for name, (weights, _) in L.BASINS.items())
_FIRST = " ".join(f"WHEN {name.lower()} = best THEN '{name}'" for name in L.BASINS)


@query(
    f"WITH s AS (SELECT doc_id, [ko, te, sf, cr, ic, de, ew, ai] AS v FROM (SELECT doc_id, {_signals_sql()} FROM documents)), b AS (SELECT doc_id, {_BASINS} FROM s),"
    f" g AS (SELECT *, greatest({', '.join(n.lower() for n in L.BASINS)}) AS best FROM b) SELECT doc_id, CASE WHEN best > 0.05 THEN CASE {_FIRST} END ELSE '' END AS basin FROM g"
)
def g21_basins(spark, sf):
    signals = table(spark, sf, "documents").select("doc_id", F.transform(X.structural(F.col("text")), lambda x: F.round(x, 6)).alias("v"))
    return signals.select("doc_id", X.basin(F.col("v")).alias("basin"))


@query(f"WITH {ADDRESS} SELECT address, regexp_split_to_array(replace(address, '_via_', '+'), '\\+') AS p FROM addressed GROUP BY address".replace("AS p FROM", "[1] AS leading FROM"))
def g25_address_parts(spark, sf):
    """Addresses and the dimension that leads them."""
    return g22_address(spark, sf).select("address").distinct().select("address", X.address_parts(F.col("address"))[0].alias("leading"))
