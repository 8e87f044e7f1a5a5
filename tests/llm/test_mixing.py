from collections import Counter, defaultdict

from skarn.llm import mixing
from skarn.llm.queries import op4_mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        goal = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and goal[s] > 3 * sizes[s]}
        if not over:
            return goal
        capped |= over


def verify(rows, sizes):
    goal = brute_targets(sizes)
    taken = defaultdict(int)
    for source, size, source_size, target, got in rows:
        assert source_size == sizes[source] and abs(target - goal[source]) <= 1e-9 * max(1, goal[source])
        assert 0 <= got <= 3 * size
        taken[source] += got
    for s, t in goal.items():
        assert taken[s] == int(t + 1e-9)


def test_query(spark, sf01):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    got = op4_mixing(spark, sf01).collect()
    sizes = Counter()
    for r in docs.values():
        sizes[r.source] += len(r.text.encode().split())
    assert len(got) == len(docs)
    assert all(r.size == len(docs[r.doc_id].text.encode().split()) for r in got)
    verify([(docs[r.doc_id].source, r.size, r.source_size, r.target, r.taken) for r in got], sizes)
    again = op4_mixing(spark, sf01).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_caps_and_epochs(spark):
    rows = [(k, "tiny", 1) for k in range(3)] + [(k, "big", 10) for k in range(100, 200)] + [(900, None, 50)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "id long, source string, size long")).collect()
    verify([(r.source, r.size, r.source_size, r.target, r.taken) for r in plan], {"tiny": 3, "big": 1000, None: 50})


def test_odd_rows(odd, empty):
    plan = mixing.mix_plan(mixing.sizes(odd)).collect()
    assert len(plan) == odd.count()
    sizes = Counter()
    for r in plan:
        sizes[r.source] += r.size
    verify([(r.source, r.size, r.source_size, r.target, r.taken) for r in plan], sizes)
    assert mixing.mix_plan(mixing.sizes(empty)).count() == 0
    assert mixing.mix(empty).count() == 0


def test_applied_mix_agrees_with_plan(spark, sf01, odd):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    plan = {r.id: r.taken for r in mixing.mix_plan(mixing.sizes(docs)).collect()}
    got = {r.doc_id: r.mix_taken for r in mixing.mix(docs).collect()}
    assert got == plan
    mixed = mixing.mix(odd)
    assert mixed.columns == [*odd.columns, "mix_size", "mix_epochs", "mix_taken"] and mixed.count() == odd.count()


def test_plans_agree_whatever_is_broadcast(spark, sf01, monkeypatch):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    got = []
    for bound in (50_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
        got.append(sorted((r.doc_id, r.mix_taken) for r in mixing.mix(docs).collect()))
    assert got[0] == got[1]


def test_rows_without_an_id_and_names(spark):
    """A third of all rows alike: none is lost, and the budget is met to the word in the plan."""
    rows = [(None, "a b c", "s", 1, 2, 3)] * 400 + [(k, "a b c", "s", 1, 2, 3) for k in range(400)] + [(1000 + k, "a b c d", "t", 1, 2, 3) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size int, epochs int, cut int")
    plan = mixing.mix_plan(mixing.sizes(docs)).collect()
    assert len(plan) == len(rows)
    verify([(r.source, r.size, r.source_size, r.target, r.taken) for r in plan], {"s": 2400, "t": 1600})
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "text", "source", "epochs", "cut", "mix_size", "mix_epochs", "mix_taken"]
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += r.mix_taken
    goal = brute_targets({"s": 2400, "t": 1600})
    assert all(goal[s] - 400 < taken[s] <= goal[s] for s in goal)
