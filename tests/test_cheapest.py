"""Cheapest balanced separators against all candidates in plain Python."""

import random
from itertools import combinations

import pytest

from hyperloom.operators import components


def parts(edges, gone):
    left, out = [vs - gone for vs in edges.values() if vs - gone], []
    while left:
        seen, rest = [left[0]], left[1:]
        reach = set(left[0])
        while more := [vs for vs in rest if vs & reach]:
            rest = [vs for vs in rest if not vs & reach]
            seen += more
            reach |= set().union(*more)
        out.append(len(seen))
        left = rest
    return out


def test_cheapest_balanced(spark):
    """Random graphs with costs that tie, are 0 or fractions; all costs 0; cliques, where no candidate is balanced."""
    rng, graphs, cost = random.Random(8), {}, {}
    for g in range(40):
        n = rng.randint(3, 9)
        graphs[g] = {e: frozenset(rng.sample(range(n), rng.randint(1, 3))) for e in range(1, rng.randint(3, 10))}
        cost |= {(g, e): rng.choice([0, 0.1, 0.7, 1, 2.5, 30, 400]) for e in graphs[g]}
    graphs[100] = {e: frozenset((e, e % 9 + 1)) for e in range(1, 10)}
    graphs[101] = {e: frozenset(p) for e, p in enumerate(combinations(range(9), 2), 1)}
    cost |= {(100, e): 0.0 for e in graphs[100]} | {(101, e): float(e) for e in graphs[101]}
    inc = spark.createDataFrame([(g, e, v) for g, edges in graphs.items() for e, vs in edges.items() for v in vs], "g long, e long, v long").cache()
    costs = spark.createDataFrame([(g, e, float(c)) for (g, e), c in cost.items()], "g long, e long, cost double")
    got = {r["g"]: r for r in components.cheapest_balanced(inc, costs, 3).collect()}
    assert set(got) == set(graphs)
    fewer = 0
    for g, edges in graphs.items():
        every = [c for k in (1, 2, 3) for c in combinations(sorted(edges), k)]
        hits = [c for c in every if max(parts(edges, frozenset().union(*(edges[e] for e in c))), default=0) <= len(edges) // 2]
        r = got[g]
        assert r["tested"] <= len(every)
        fewer += r["tested"] < len(every)
        if not hits:
            assert r["s"] is None and r["cost"] is None and r["tested"] == len(every)
            continue
        total = lambda c, g=g: sum(sorted(cost[g, e] for e in c))
        best = min(map(total, hits))
        assert r["cost"] == pytest.approx(best)
        assert tuple(map(int, r["s"].split(","))) in {c for c in hits if total(c) == pytest.approx(best)}
    assert got[101]["s"] is None and fewer > 20


def test_bad_costs(spark):
    inc = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], "g long, e long, v long")
    for costs in ([(1, 1, 2.0)], [(1, 1, 2.0), (1, 2, -1.0)]):
        with pytest.raises(Exception, match="no cost"):
            components.cheapest_balanced(inc, spark.createDataFrame(costs, "g long, e long, cost double")).collect()
