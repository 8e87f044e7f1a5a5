import random
import re

from skarn.llm import decontaminate
from skarn.llm.queries import op8_decontaminate


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_common_subsequence():
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert decontaminate.common(decontaminate.positions(np.array(a)), len(a), np.array(b)) == brute_common(a, b)


def test_query_finds_copied_items(spark, sf01):
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf01}/benchmark.parquet").collect()}
    got = {r.doc_id: r for r in op8_decontaminate(spark, sf01).collect()}
    assert got.keys() == docs.keys()
    joined = {d: " " + " ".join(w) + " " for d, w in docs.items()}
    copied = {(d, i) for i, w in items.items() for d, x in joined.items() if f" {' '.join(w)} " in x}
    assert copied
    assert copied <= {(d, i) for d, r in got.items() for i in r.item_ids}
    grams = {tuple(w[k : k + 6]) for w in items.values() for k in range(len(w) - 5)}
    for d, r in got.items():
        if r.contaminated:
            assert any(tuple(docs[d][k : k + 6]) in grams for k in range(len(docs[d]) - 5))


def edited(item, rng, share):
    out = []
    for w in item:
        x = rng.random()
        out += [] if x < share / 3 else [w, "extra"] if x < 2 * share / 3 else ["other"] if x < share else [w]
    return out


def test_paraphrases_are_found_and_recall_measured(spark, sf01):
    """Windows against all items by brute force: recall of the latent search on edited copies."""
    rng = random.Random(7)
    docs = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").limit(400)
    clean = [r.text.split() for r in docs.collect() if len(r.text.split()) > 150]
    items = spark.read.parquet(f"{sf01}/benchmark.parquet").collect()
    planted = []
    for k in range(120):
        item = words(items[k % len(items)].text)
        host = list(rng.choice(clean))
        at = rng.randrange(len(host))
        planted.append((10_000 + k, " ".join(host[:at] + edited(item, rng, 0.15) + host[at:])))
    table = docs.union(spark.createDataFrame(planted, "doc_id long, text string"))
    found = {r.doc_id: {x["item"] for x in r.leaks if x["share"] > 0} for r in decontaminate.leaks(table, spark.createDataFrame(items)).collect()}
    want, hit = 0, 0
    for k, (d, text) in enumerate(planted):
        item = items[k % len(items)]
        w = words(text)
        if max(brute_common(words(item.text), w[a : a + 90]) for a in range(0, len(w), 30)) >= 0.8 * len(words(item.text)):
            want += 1
            hit += item.item_id in found[d]
    assert want > 60 and hit >= 0.9 * want


def test_synonym_edits_are_found(spark, sf01):
    """Three words in ten replaced, or foreign words put between, the answer as it is: nine in ten are found."""
    rng = random.Random(11)
    docs = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text")
    hosts = [w for w in (words(r.text) for r in docs.limit(400).collect()) if len(w) > 150]
    items = spark.read.parquet(f"{sf01}/benchmark.parquet").collect()
    planted = []
    for k in range(160):
        text = items[k % len(items)].text
        sentences = [s for s in text.replace("\n", ". ").split(". ") if len(words(s)) >= 3]
        answer = words(sentences[-1])
        body = words(text)
        body = body[: len(body) - len(answer)] if body[-len(answer) :] == answer else body
        said = [f"syn{rng.randrange(999)}" if rng.random() < 0.3 else w for w in body] if k % 2 else [x for w in body for x in ([w, "well"] if rng.random() < 0.3 else [w])]
        host = rng.choice(hosts)
        at = rng.randrange(len(host))
        planted.append((10_000 + k, " ".join(host[:at] + said + answer + host[at:])))
    table = docs.union(spark.createDataFrame(planted, "doc_id long, text string"))
    found = {r.doc_id: {x["item"] for x in r.leaks if x["share"] > 0} for r in decontaminate.leaks(table, spark.createDataFrame(items)).collect()}
    want = hit = 0
    for k, (d, text) in enumerate(planted):
        item = items[k % len(items)]
        w, own = words(text), words(item.text)
        if max(brute_common(own, w[a : a + 2 * len(own) + 32]) for a in range(0, len(w), 16)) >= 0.6 * len(own):
            want += 1
            hit += item.item_id in found[d]
    assert want > 120 and hit >= 0.9 * want


def test_short_items_and_names(spark):
    """Items of any length and type of id; short ones as whole runs of words, within one text."""
    items = spark.createDataFrame([("a", "Two words"), ("b", "one"), ("c", "seven words of a very short item"), ("d", ""), ("e", "two words")], "item_id string, text string")
    texts = ["these two, words!", "two", "words two", "ONE", "the seven words of a very short item.", "seven words of a very short", None]
    docs = spark.createDataFrame([(k, t, "l") for k, t in enumerate(texts)], "doc_id long, text string, leaks string")
    got = decontaminate.leaks(docs, items)
    assert got.columns == docs.columns
    assert {r.doc_id: [x["item"] for x in r.leaks] for r in got.collect()} == {0: ["a", "e"], 1: [], 2: [], 3: ["b"], 4: ["c"], 5: [], 6: []}


def test_every_verbatim_copy_is_found(spark, sf01):
    """Those of a larger table, and items put into the middle of texts that have nothing to do with them."""
    large = sf01.replace("sf0.01", "sf0.1")
    docs = spark.read.parquet(f"{large}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{large}/benchmark.parquet")
    items = {r.item_id: words(r.text) for r in benchmark.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = random.Random(3)
    hosts = [w for w in map(words, list(texts.values())[:800]) if len(w) > 150]
    for k in range(1000):
        item, host = list(items.values())[k % len(items)], rng.choice(hosts)
        at = rng.randrange(len(host))
        texts[10**9 + k] = " ".join(host[:at] + item + host[at:])
    rows = docs.union(spark.createDataFrame([x for x in texts.items() if x[0] >= 10**9], "doc_id long, text string"))
    found = {r.doc_id: {x["item"] for x in r.leaks if x["share"] > 0} for r in decontaminate.leaks(rows, benchmark).collect()}
    joined = {d: " " + " ".join(words(x)) + " " for d, x in texts.items()}
    searched = {i: f" {' '.join(w)} " for i, w in items.items() if w}
    copied = {(d, i) for d, x in joined.items() for i, w in searched.items() if w in x}
    assert len(copied) > 1000
    assert copied <= {(d, i) for d, own in found.items() for i in own}


def test_odd_rows(spark, odd, empty, sf01):
    benchmark = spark.createDataFrame([(1, "the same words again the same words again"), (2, None), (3, "short"), (1, "the same words again the same words again")], "item_id long, text string")
    got = decontaminate.leaks(odd, benchmark)
    assert got.columns == [*odd.columns, "leaks"]
    rows = got.collect()
    assert len(rows) == odd.count()
    assert {r.doc_id for r in rows if any(x["share"] > 0 for x in r.leaks)} == {7, 8}
    assert decontaminate.leaks(empty, benchmark).count() == 0
    assert all(r.leaks == [] for r in decontaminate.leaks(odd, benchmark.limit(0)).collect())
