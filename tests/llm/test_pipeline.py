from collections import defaultdict

import corpus_pipeline
from skarn.llm import queries
from tests.llm.test_mixing import brute_targets
from tests.llm.test_secrets import brute as brute_secrets


def test_stages_match_what_their_operators_say(spark, sf01, tmp_path):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    columns = docs.columns
    inputs, outputs = [docs], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"s{k}")
        stage(spark, inputs[-1], sf01).write.parquet(path)
        outputs.append(spark.read.parquet(path))
        inputs.append(outputs[-1])
    assert all(o.columns == columns for o in outputs[:-1]) and outputs[-1].columns[: len(columns)] == columns
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in inputs]
    kept = {r.doc_id for r in queries.op9_quality(spark, sf01).where("kept").collect()}
    assert ids[1] == kept and ids[0] - ids[1]
    from skarn.llm import decontaminate

    benchmark = spark.read.parquet(f"{sf01}/benchmark.parquet")
    leaked = {r.doc_id for r in decontaminate.leaks(outputs[1], benchmark).collect() if any(x["share"] > 0 for x in r.leaks)}
    assert ids[3] == ids[2] - leaked and leaked
    before = {r.doc_id: r.text for r in outputs[2].collect()}
    for r in outputs[3].collect():
        if brute_secrets(before[r.doc_id])[:3] == (0, 0, 0):
            assert r.text == before[r.doc_id] or "<SECRET>" in r.text
        assert sum(brute_secrets(r.text)[:3]) == 0 and r.n_chars == len(r.text)
    assert ids[4] == ids[3]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in outputs[3].collect():
        sizes[r.source] += len(r.text.encode().split())
    for r in outputs[4].collect():
        taken[r.source] += r.taken
        assert 0 < r.taken <= 3 * r.size
    for source, goal in brute_targets(sizes).items():
        assert taken[source] == int(goal + 1e-9)


def test_run_equals_the_stages(spark, sf, tmp_path):
    first = corpus_pipeline.run(spark, sf)
    assert first.count() == len({r.doc_id for r in first.collect()})
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
