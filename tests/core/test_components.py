import random

import pytest

from skarn.operators import components
from skarn.operators.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("rows", [100, components.PART_ROWS])
def test_random_paths_hubs_and_loops(spark, monkeypatch, rows):
    monkeypatch.setattr(components, "PART_ROWS", rows)
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(1000, 1400)]  # a long path
    edges += [(5000, 5001 + k) for k in range(700)]  # a hub
    edges += [(rng.randrange(6000, 6500), rng.randrange(6000, 6500)) for _ in range(400)]
    edges += [(9000, 9000), (9001, 9001), (9001, 9002), (None, 1), (2, None), (9002, 9001), (9002, 9001)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == brute(edges)


def test_strings_and_empty(spark):
    edges = [("b", "a"), ("c", "b"), ("x", "é")]
    got = connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {r.node: r.component for r in got} == brute(edges)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("bits", [2, components.BLOCK_BITS])
def test_sequences_by_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(components, "BLOCK_BITS", bits)
    monkeypatch.setattr(components, "MORE_BITS", 8)
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(-50, 300)]  # a path over many blocks
    edges += [(k, k + rng.randrange(1, 20)) for k in range(1000, 1600) if rng.random() < 0.4]
    edges += [(a := rng.randrange(3000, 4000), rng.randrange(a, 4000)) for _ in range(300)] + [(7, 7), (9000, 9000), (None, 1), (9001, 2**50), (2**50, 9001)]
    got = components.sequence_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == brute(edges)
    assert components.sequence_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_fission_along_a_sequence(spark, monkeypatch):
    from skarn.operators import coupling

    monkeypatch.setattr(components, "BLOCK_BITS", 5)
    rng = random.Random(5)
    edges = [(k, k + d, round(rng.random(), 5)) for k in range(200) for d in range(1, 5) if rng.random() < 0.5]
    t = spark.createDataFrame(edges, "src long, dst long, gamma double")
    one, other = ({r.node: r.component for r in coupling.fission(t, 200, sequence=s).collect()} for s in (True, False))
    assert one == other and len(set(one.values())) > 2
