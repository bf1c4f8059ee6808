"""Distances without an edge against breadth-first search in each graph without it."""

import random

import pytest

from hyperloom.operators import distances


def search(edges):
    out, near = {}, {}
    for vs in edges.values():
        for v in vs:
            near.setdefault(v, set()).update(vs - {v})
    for a in near:
        seen, todo = {a: 0}, [a]
        for v in todo:
            for w in near[v] - seen.keys():
                seen[w] = seen[v] + 1
                todo.append(w)
        out |= {(a, b): d for b, d in seen.items() if b != a}
    return out


@pytest.fixture(scope="module")
def graphs():
    """Random graphs; a long cycle, where each edge stretches most pairs; a path; parallel paths; equal edges; single vertices."""
    rng, out = random.Random(2), {}
    for g in range(80):
        n = rng.randint(3, 12)
        out[g] = {e: frozenset(rng.sample(range(n), rng.randint(1, 3))) for e in range(1, rng.randint(3, 14))}
    out[100] = {e: frozenset((e, e % 15 + 1)) for e in range(1, 16)}
    out[101] = {e: frozenset((e, e + 1)) for e in range(1, 13)}
    out[102] = {e: frozenset(p) for e, p in enumerate([(0, 1), (1, 9), (0, 2), (2, 9), (0, 3), (3, 4), (4, 9), (9, 10), (10, 11)], 1)}
    out[103] = {1: frozenset((1, 2)), 2: frozenset((1, 2)), 3: frozenset((2, 3))}
    out[104] = {1: frozenset((1,)), 2: frozenset((2,))}
    return out


def test_distance_change(spark, graphs):
    inc = spark.createDataFrame([(g, e, v) for g, edges in graphs.items() for e, vs in edges.items() for v in vs], "g long, e long, v long").cache()
    got = {(r["g"], r["e"]): (r["stretched"], r["lost"]) for r in distances.distance_change(inc).collect()}
    want = {}
    for g, edges in graphs.items():
        before = search(edges)
        for e in edges if before else ():
            after = search({k: vs for k, vs in edges.items() if k != e})
            want[g, e] = sum(after[p] - d for p, d in before.items() if p in after), sum(p not in after for p in before)
    assert got == want
    # Pairs to search again are few beside all pairs in all graphs without an edge.
    steps, dist = distances.primal_steps(inc), distances.primal_distances(inc)
    copies = sum(len(edges) * len(search(edges)) for edges in graphs.values())
    assert 0 < distances.needed_edges(steps, dist).count() < copies / 2


def test_no_rows(spark):
    none = spark.createDataFrame([], "g long, e long, v long")
    assert distances.distance_change(none).collect() == []
