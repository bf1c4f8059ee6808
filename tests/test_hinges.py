"""Hinge trees by joins against their definition and the recursive helper, and trees grafted from those of the parts."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hyperloom.operators import frontier, hinges, solvers, trees


def components(edges, gone):
    left = {e: vs - gone for e, vs in edges.items() if vs - gone}
    out = []
    while left:
        seen = {next(iter(left))}
        reach = set().union(*(left[e] for e in seen))
        while more := {e for e in left if e not in seen and left[e] & reach}:
            seen |= more
            reach |= set().union(*(left[e] for e in more))
        out.append(seen)
        left = {e: vs for e, vs in left.items() if e not in seen}
    return out


@pytest.fixture(scope="module")
def graphs():
    """Random sparse graphs (some in several pieces, some with edges inside others), a star whose edges separate each other, cycles at a core, a path, one edge, a clique."""
    rng, out = random.Random(9), {}
    for g in range(60):
        n = rng.randint(3, 16)
        out[g] = {e: frozenset(rng.sample(range(1, n + 1), rng.randint(1, min(3, n)))) for e in range(1, rng.randint(2, 14))}
    out[100] = {e: frozenset((1, e + 1)) for e in range(1, 9)}
    core = [(1, 2), (2, 3), (3, 4), (4, 1)] + [pair for v in (1, 2, 3, 4) for pair in ((v, 10 * v), (10 * v, 10 * v + 1), (10 * v + 1, v))]
    out[101] = {e: frozenset(vs) for e, vs in enumerate(core, 1)}
    out[102] = {e: frozenset((e, e + 1)) for e in range(1, 21)}
    out[103] = {7: frozenset((1, 2, 3))}
    out[104] = {e: frozenset(p) for e, p in enumerate(((a, b) for a in range(1, 6) for b in range(a + 1, 6)), 1)}
    return out


@pytest.fixture(scope="module")
def inc(spark, graphs):
    return spark.createDataFrame([(g, e, v) for g, edges in graphs.items() for e, vs in edges.items() for v in vs], "g long, e long, v long").cache()


@pytest.fixture(scope="module")
def tree(inc):
    return hinges.hinge_tree(inc).cache()


def test_parts_are_minimal_and_form_a_tree(tree, graphs):
    found = defaultdict(lambda: defaultdict(set))
    link = {}
    for r in tree.collect():
        assert r["e"] not in found[r["g"]][r["part"]]
        found[r["g"]][r["part"]].add(r["e"])
        assert link.setdefault((r["g"], r["part"]), (r["parent"], r["shared"])) == (r["parent"], r["shared"])
    assert set(found) == set(graphs)
    for g, parts in found.items():
        edges = graphs[g]
        assert set().union(*parts.values()) == set(edges)
        for part, members in parts.items():
            inside = {e: edges[e] for e in members}
            assert all(len(components(inside, edges[x])) <= 1 for x in members), (g, part)
            seen, at = set(), part
            while at is not None:
                assert at not in seen
                seen.add(at)
                at = link[g, at][0]
            assert 0 in seen
            parent, shared = link[g, part]
            if parent is not None:
                assert members & parts[parent] == {shared}
        # Vertices that two parts have are in each shared edge between them: those of a vertex are connected in the tree.
        for v in set().union(*edges.values()):
            having = {p for p, members in parts.items() if any(v in edges[e] for e in members)}
            tops = [p for p in having if link[g, p][0] not in having]
            assert len(tops) == 1
            assert all(v in edges[link[g, p][1]] for p in having if p not in tops)


def test_largest_part_is_that_of_another_order(tree, graphs, inc):
    """Which edges are split first does not change the number of edges in the largest part of a graph without edges inside others."""
    got = {r["g"]: r["edges"] for r in hinges.largest_hinge(tree).collect()}
    for g, edges in graphs.items():
        if any(a <= b for x, a in edges.items() for y, b in edges.items() if x != y):
            continue
        assert got[g] == max(len(part) for _, _, part in solvers.hinges(edges)), g
    assert got[101] == 4 and got[102] == 2 and got[104] == 10


def test_grafted_trees(spark, tree, inc, graphs):
    """Parts are solved as graphs of their own and grafted: valid trees of the whole graphs; one missing part leaves its graph out."""
    parts = hinges.part_graphs(tree, inc)
    solved = frontier.trees_of(*frontier.solve(parts, 2), 2).cache()
    whole = hinges.graft(tree, solved, inc).cache()
    yes = {r["g"] for r in whole.select("g").distinct().collect()}
    every = {r["g"]: r["n"] for r in tree.groupBy("g").agg(F.count_distinct("part").alias("n")).collect()}
    with_tree = {r["g"]: r["n"] for r in solved.select("g.g", "g.part").distinct().groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert yes == {g for g, n in every.items() if with_tree.get(g) == n}
    assert {100, 101, 102, 103} <= yes and 104 not in yes
    checks = trees.validate(whole, inc).collect()
    assert len(checks) == len(yes) and all(r["valid"] and r["width"] <= 2 for r in checks)
    for r in whole.groupBy("g").agg(F.sum(F.col("parent").isNull().cast("int")).alias("roots"), F.count("*").alias("n"), F.count_distinct("node").alias("ids")).collect():
        assert r["roots"] == 1 and r["n"] == r["ids"]
    assert trees.intervals(whole).count() == whole.count()


def test_empty(spark):
    none = spark.createDataFrame([], "g long, e long, v long")
    tree = hinges.hinge_tree(none)
    assert tree.collect() == [] and hinges.largest_hinge(tree).collect() == []
