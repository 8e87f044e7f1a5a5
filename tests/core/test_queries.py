"""Every registered query against its SQL on the small tables, and known values of single operators."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from skarn.functions import grammar, similarity
from skarn.functions import text as X
from skarn.operators import corpus, coupling, formations, profile, retrieval
from skarn.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1.1e-4)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.oracle_sql():
        assert df.columns
        return
    got = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in duck.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = [tuple(r[k] for k in order) for r in got.fetchall()]
    key = lambda r: [repr(x) for x in r if not isinstance(x, float)] + [round(x, 3) for x in r if isinstance(x, float)]
    rows.sort(key=key)
    want.sort(key=key)
    assert len(rows) == len(want)
    assert all(close(a, b) for x, y in zip(rows, want, strict=True) for a, b in zip(x, y, strict=True))


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def test_similarity_values(spark):
    a, b = F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(0.4), F.lit(0.4))
    assert one(spark, similarity.gamma(a, b)) == pytest.approx(0.4)
    assert one(spark, similarity.blended(F.lit(0.4), F.lit(1), F.lit(0), F.lit(False))) == pytest.approx(0.43)
    assert one(spark, similarity.gamma(F.array(F.lit(0.0)), F.array(F.lit(0.0)))) == 0
    assert one(spark, similarity.angle(a, b)) == pytest.approx(0, abs=1e-7)
    assert one(spark, similarity.wrapping(F.lit(0.5))) == round(math.atan(2) / 0.5)
    chain = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, similarity.directed(chain("KO", "IC"), chain("EW"), chain("KO"), chain("KO"), chain("a"), chain("b"))) == pytest.approx(0.5 * 0.8 + 0.3)


def test_addresses_and_health(spark):
    vector = lambda **kw: F.array(*(F.lit(float(kw.get(d, 0))) for d in ("KO", "TE", "SF", "CR", "IC", "DE", "EW", "AI")))
    assert one(spark, X.address(vector(IC=1))) == "FEELING"
    assert one(spark, X.address(vector(EW=0.9, CR=0.4))) == "ACTING+RELATING"
    assert one(spark, X.address(vector(EW=0.9, IC=0.3, CR=0.4))) == "ACTING+RELATING_via_FEELING"
    assert one(spark, X.address(vector())) == "UNKNOWN"
    regime = lambda n, s, d: one(spark, formations.health(F.lit(n), F.lit(s), F.lit(d)))
    assert [regime(3, 1.0, 1.0), regime(9, 0.5, 1.0), regime(9, 0.25, 1.0), regime(9, 0.0, 0.1), regime(60, 0.0, 0.1)] == ["SEEDLING", "POVERTY", "DIGNITY", "PATHOLOGY", "CONTAGION"]
    assert one(spark, X.conservation(F.array(F.lit(1.0), F.lit(3.0)))) == [0.75, 0.25]


def test_grammar():
    lexicon = grammar.Lexicon(operations={"build": ("EW", "make"), "test": ("TE", "try")})
    p = grammar.parse("We build it and she tests the knowledge quickly", lexicon)
    assert p["operations"] == ["EW:make", "TE:try"] and p["op_chain"] == "EW:make>TE:try"
    assert "EW>CR" in p["chains"] and all(0 <= v <= 1 for v in p["vector"])
    assert grammar.parse(None, lexicon)["vector"] == [0.0] * 8
    assert lexicon.stem("building") == "build" and lexicon.stem("runs") == "runs"
    assert [grammar.word_class(w) for w in ("the", "is", "me", "you", "with", "quickly", "running", "nation", "useful", "xyz")] == [
        "stop", "aux", "pron_self", "pron_other", "prep_rel", "adv", "verb", "noun", "adj", "unknown",
    ]


def test_statistics_do_not_depend_on_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = []
    for shaped in (docs.repartition(1), docs.repartition(16).orderBy(F.desc("doc_id"))):
        lists = corpus.token_lists(shaped)
        stats = corpus.token_stats(lists)
        found.append({tuple(r) for r in corpus.vocabulary(stats, corpus.corpus_stats(lists), 50).select("pos", "term").collect()})
    assert found[0] == found[1]


def test_pairs_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, ""), (3, None), (4, "x " * 9 + "y z")], "doc_id long, text string")
    got = {(r.t1, r.t2): r.n for r in corpus.pair_stats(corpus.token_lists(docs)).collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 2, ("b", "c"): 1, ("x", "y"): 9, ("x", "z"): 8, ("y", "z"): 1}


def test_neighbours_meet_once(spark):
    rows = spark.range(100).select(F.col("id").alias("seq"))
    pairs = [(r.a_seq, r.b_seq) for r in coupling.neighbours(rows, "seq").collect()]
    assert sorted(pairs) == [(a, b) for a in range(100) for b in range(a + 1, min(100, a + 20))]


def test_docket_and_feedback(spark):
    text = "# Open work\n- first item\n- [x] done\n# Notes\n- no item\n- [ ] a box\n"
    got = profile.docket(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), "doc_id", "text").collect()
    assert [(r.id, r.item) for r in got] == [(1, "- first item"), (1, "- [ ] a box")]
    events = spark.createDataFrame([("a", k, True) for k in range(20)] + [("b", 0, False)], "k string, t long, ok boolean")
    weights = {r.k: r.weight for r in profile.feedback(events, "k", ["t"], "ok").collect()}
    assert weights == {"a": 3.0, "b": 0.85}


def test_routing_and_recall(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta beta", "m"), (2, "gamma gamma alpha", "n"), (3, None, "n")], "doc_id long, text string, source string")
    index = retrieval.member_index(docs, "source")
    assert [r.member for r in retrieval.route(index, "beta?").collect()] == ["m"]
    assert [r.id for r in retrieval.recall(docs, "alpha beta").collect()] == [1, 2]


def test_sql_functions_and_dimensions(spark):
    from skarn.functions import sql

    sql.register(spark)
    row = spark.sql("SELECT gamma(array(1D, 1D), array(0.4D, 0.4D)) g, gamma(array(0D), array(0D)) z, tokens('Ab c1D') t, su_dimensions(6) d").first()
    assert (row.g, row.z, row.t, row.d) == (pytest.approx(0.4), 0.0, ["ab", "c", "d"], 35)
    rows = spark.createDataFrame([([float(k), 2.0 * k, 0.0],) for k in range(10)], "v array<double>")
    assert profile.effective_dimension(rows, "v")[0] == 1
    centres = spark.createDataFrame([("A", [1.0, 0.0], 2), ("B", [0.9, 0.0], 1), ("C", [0.0, 1.0], 1)], "k string, v array<double>, n int")
    assert {r.k: r.merged for r in formations.merge(centres, "k", "v", "n", target=2).collect()} == {"A": "A", "B": "A", "C": "C"}


def test_chains_evolve(spark):
    rows = lambda *cs: spark.createDataFrame([(c, 0.5) for c in cs], "chain string, ache double")
    first = formations.evolve(None, rows(*["A>B"] * 3, *["C"] * 5, "D>E"), 1)
    assert {(r.chain, r.n, r.born) for r in first.collect()} == {("A>B", 3, 1), ("C", 5, None), ("D>E", 1, None)}
    second = formations.evolve(first, rows(*["A>B>A>B"] * 4, "D>E", "D>E"), 2)
    got = {r.chain: (r.n, r.born, r.uses) for r in second.collect()}
    assert got["D>E"] == (3, 2, 0) and got["A>B"] == (3, 1, 0)
    last = formations.evolve(second, rows("C"), 30)
    assert "A>B" not in {r.chain for r in last.collect()}


def test_words_take_dimensions_from_class_and_neighbours():
    lexicon = grammar.Lexicon({"love": {"IC": 1.0}, "test": {"TE": 1.0, "KO": 0.5}}, {"make": ("EW", "make")})
    scores = lambda before, word, after, context=None: grammar.word_scores(word, grammar.word_class(word), before, after, lexicon, context)[0]
    assert scores("made", "nation", "love") == {"IC": 0.3}
    assert scores("testing", "nation", "love") == {"TE": 0.3, "KO": 0.3, "IC": 0.3}
    assert scores("love", "useful", "testing") == {"IC": 0.1, "TE": 0.3, "KO": 0.3}
    assert scores("x", "useful", "y") == {"IC": 0.1} and scores("x", "nation", "y") == {}
    assert scores("with", "sprinting", "x") == {"CR": 0.4} and scores("we", "sprinting", "x") == {"IC": 0.3, "AI": 0.2}
    assert scores("x", "sprinting", "y") == {"EW": 0.3} and scores("x", "make", "y") == {"EW": 1.0}
    assert scores("x", "useful", "y", {"useful": {"DE": 1.0}}) == {"IC": 0.1, "DE": 0.5}
    assert scores("x", "sprinting", "y", {"sprinting": {"DE": 1.0}}) == {"EW": 0.3}  # not weak


def test_context_spreads_exemplar_dimensions(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["love apple", "love apple", "test apple", "pear test", "plum fig"])], "doc_id long, text string")
    lists = corpus.token_lists(docs)
    stats = corpus.token_stats(lists)
    totals = corpus.corpus_stats(lists, corpus.pair_stats(lists))
    got = corpus.propagated(lists, {"love": ["IC"], "test": ["TE"]}, stats, totals)
    assert got["apple"]["IC"] == 1.0 and set(got) <= {"apple", "pear", "love", "test"} and got["pear"] == {"TE": 1.0}
    assert got["apple"].get("TE", 0) < 1


def test_pairs_around_and_among_are_those_of_all_pairs(spark, sf):
    lists = corpus.token_lists(spark.read.parquet(f"{sf}/documents.parquet").limit(60))
    every = {(r.t1, r.t2): r.n for r in corpus.pair_stats(lists).collect()}
    terms = sorted({t for pair in list(every)[:40] for t in pair})
    around = {(r.t1, r.t2): r.n for r in corpus.pairs_around(lists, terms).collect()}
    assert around == {p: n for p, n in every.items() if p[0] in terms or p[1] in terms}
    wanted = sorted(p for p in every if p[0] in terms and p[1] in terms)[::2]
    among = corpus.pairs_among(lists, terms, spark.createDataFrame(wanted, "t1 string, t2 string"))
    assert {(r.t1, r.t2): r.n for r in among.collect()} == {p: every[p] for p in wanted}
    assert lists.agg(F.sum(corpus.pair_mass(F.col("words")))).first()[0] == sum(every.values())


def brute_fission(edges, total, share=0.15, least=2):
    """Breadth-first search over what is left of each oversized component, round by round."""

    def parts(nodes, links):
        near = {n: set() for n in nodes}
        for a, b, _ in links:
            near[a].add(b)
            near[b].add(a)
        out, seen = [], set()
        for n in nodes:
            if n not in seen:
                own, queue = {n}, [n]
                while queue:
                    new = near[queue.pop()] - own
                    own |= new
                    queue += new
                seen |= own
                out.append(own)
        return out

    edges = [(a, b, round(g, 4)) for a, b, g in edges]
    found = parts({n for a, b, _ in edges for n in (a, b)}, edges)
    for k in range(10):
        after, split = [], False
        for own in found:
            if len(own) <= share * total:
                after.append(own)
                continue
            inside = sorted(g for a, b, g in edges if a in own)
            cut = inside[max(1, len(inside) * min(30 + 5 * k, 70) // 100) - 1] if inside else 0
            edges = [e for e in edges if e[0] not in own or e[2] > cut]
            new = parts(own, [e for e in edges if e[0] in own])
            split |= len(new) > 1
            after += [x for x in new if len(x) >= least] if len(new) > 1 else [own]
        found = after
        if not split:
            break
    return {n: min(own) for own in found for n in own}


def test_fission_against_brute_force(spark):
    rng = random.Random(4)
    edges = sorted({(min(p), max(p)) for p in ((rng.randrange(60), rng.randrange(60)) for _ in range(220)) if p[0] != p[1]})
    edges = [(a, b, round(rng.random(), 5)) for a, b in edges] + [(100, 101, 0.5), (101, 102, 0.6)]
    got = coupling.fission(spark.createDataFrame(edges, "src long, dst long, gamma double"), 80).collect()
    want = brute_fission(edges, 80)
    assert {r.node: r.component for r in got} == want and len(set(want.values())) > 2


def test_feedback_folds_days_and_decays(spark):
    rng = random.Random(6)
    rows = [(k % 5, f"2024-01-{rng.randrange(1, 20):02d} {rng.randrange(24):02d}:00:00", k, rng.random() < [0.9, 0.5, 0.1, 0.6, 0.7][k % 5]) for k in range(600)]
    events = spark.createDataFrame(rows, "key int, at string, id int, good boolean").withColumn("ts", F.col("at").cast("timestamp"))
    got = {r.key: r.weight for r in profile.feedback(events, "key", ["ts", "id"], "good", now=F.lit("2024-01-21").cast("timestamp")).collect()}
    for key in range(5):
        w, own = 1.0, sorted((at, i, g) for k, at, i, g in rows if k == key)
        for _, _, good in own:
            w = min(3.0, w * 1.1) if good else max(0.1, w * 0.85)
        w = max(0.1, w * 0.95) if own[-1][0] < "2024-01-14" else w
        assert got[key] == pytest.approx(w)
