"""The reduction undone, preorder intervals, and bounded covers against plain Python."""

import random
from itertools import combinations
from math import comb

import pytest
from pyspark.sql import functions as F

from hyperloom.operators import components, frontier, reductions, trees

TREE = "g long, node int, parent int, bag array<long>, cover array<long>"


@pytest.fixture(scope="module")
def graphs():
    """Random graphs, acyclic ones among them, parts that do not touch, equal edges, one edge, and a cycle with pendant chains."""
    rng, out = random.Random(5), {}
    for g in range(60):
        n = rng.randint(2, 9)
        out[g] = [frozenset(rng.sample(range(1, n + 1), rng.randint(1, min(4, n)))) for _ in range(rng.randint(1, 9))]
    out[100] = [frozenset((i, i + 1)) for i in range(1, 12)]
    out[101] = [frozenset((1, 2)), frozenset((1, 2)), frozenset((1, 2)), frozenset((7,))]
    out[102] = [frozenset((i, i % 5 + 1)) for i in range(1, 6)] + [frozenset((1, 11)), frozenset((11, 12)), frozenset((12, 13)), frozenset((2, 3, 20)), frozenset((20, 21))]
    out[103] = [frozenset((3, 4, 5))]
    out[104] = [frozenset((1, 2)), frozenset((5, 6)), frozenset((6, 7)), frozenset((9,))]
    return out


@pytest.fixture(scope="module")
def inc(spark, graphs):
    return spark.createDataFrame([(g, e, v) for g, edges in graphs.items() for e, vs in enumerate(edges, 1) for v in vs], "g long, e long, v long").cache()


def is_decomposition(edges, nodes):
    """One root, one tree, every edge in a bag, bags within covers, nodes of a vertex connected."""
    by, roots = {n["node"]: n for n in nodes}, [n for n in nodes if n["parent"] is None]
    if len(by) != len(nodes) or len(roots) != 1:
        return False
    for n in nodes:
        seen, at = set(), n["node"]
        while at is not None:
            if at in seen or at not in by:
                return False
            seen.add(at)
            at = by[at]["parent"]
        if not set(n["bag"]) <= set().union(*(edges[e - 1] for e in n["cover"])):
            return False
    if not all(any(e <= set(n["bag"]) for n in nodes) for e in edges):
        return False
    for v in set().union(*edges):
        held = [n for n in nodes if v in n["bag"]]
        if sum(n["parent"] is None or v not in by[n["parent"]]["bag"] for n in held) != 1:
            return False
    return True


def grouped(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["g"], []).append(r.asDict())
    return out


def one_node(residue):
    lists = residue.groupBy("g").agg(F.array_sort(F.collect_set("v")).alias("bag"), F.array_sort(F.collect_set("e")).alias("cover"))
    return lists.select("g", F.lit(3).alias("node"), F.lit(None).cast("int").alias("parent"), "bag", "cover")


def test_log_and_residue(inc, graphs):
    residue, log = reductions.gyo_logged(inc)
    assert set(map(tuple, residue.collect())) == set(map(tuple, reductions.gyo(inc).select("g", "e", "v").collect()))
    left = {(r["g"], r["e"]) for r in residue.collect()}
    gone = {(r["g"], r["e"]): r["parent"] for r in log.collect()}
    assert log.count() == len(gone) and left | set(gone) == {(g, e) for g, edges in graphs.items() for e in range(1, len(edges) + 1)} and not left & set(gone)
    for (g, e), parent in gone.items():
        at, steps = parent, 0
        while at is not None:
            at, steps = gone.get((g, at)), steps + 1
            assert steps <= len(graphs[g])


def test_undone_trees_are_decompositions(inc, graphs):
    residue, log = reductions.gyo_logged(inc)
    found = grouped(reductions.undo_gyo(one_node(residue), inc, residue, log))
    assert set(found) == set(graphs)
    counts = {r["g"]: r["n"] for r in residue.groupBy("g").agg(F.count_distinct("e").alias("n")).collect()}
    for g, nodes in found.items():
        assert is_decomposition(graphs[g], nodes), g
        assert max(len(n["cover"]) for n in nodes) == max(1, counts.get(g, 0))
        assert len(nodes) == len(graphs[g]) - counts.get(g, 0) + (g in counts)


def test_undone_over_types_and_searched_trees(spark, inc, graphs):
    """Type collapse, reduction, search, undo and types again: width 2 or less wherever the search says yes. Residual edges that no cover names get leaves."""
    some = inc.where("g < 12 OR g >= 100").cache()
    kept, members = reductions.type_collapse(some)
    residue, log = reductions.gyo_logged(kept)
    verdicts, choices, roots = frontier.solve(residue, 2)
    made = frontier.trees_of(verdicts, choices, roots, 2)
    whole = trees.restore_types_in_bags(reductions.undo_gyo(made, kept, residue, log), members)
    said = {r["g"]: r["verdict"] for r in verdicts.collect()}
    found = grouped(whole)
    assert said[102] == "yes"
    assert set(found) == {g for g in graphs if (g < 12 or g >= 100) and said.get(g, "yes") == "yes"}
    for g, nodes in found.items():
        assert is_decomposition(graphs[g], nodes), g
        assert max(len(n["cover"]) for n in nodes) <= 2


def test_undo_of_bare_and_lacking_trees(spark):
    """A residual edge that lost a vertex and is in no cover gets a leaf; a tree that misses a residual edge gives no rows."""
    rows = [(g, e, v) for g in (1, 2) for e, vs in ((1, (1, 2, 9)), (2, (2, 3)), (3, (1, 3)), (4, (1, 2, 3, 8)), (5, (8, 9)), (6, (9, 30))) for v in vs]
    inc = spark.createDataFrame(rows, "g long, e long, v long")
    residue, log = reductions.gyo_logged(inc)
    assert {r["e"] for r in residue.where("g = 1").collect()} == {1, 4, 5}
    tree = spark.createDataFrame([(1, 0, None, [1, 2, 8], [4]), (1, 1, 0, [1, 2, 8, 9], [1, 4]), (2, 0, None, [1, 2, 8], [4])], TREE)
    found = grouped(reductions.undo_gyo(tree, inc, residue, log))
    assert set(found) == {1} and is_decomposition([frozenset(x) for x in ((1, 2, 9), (2, 3), (1, 3), (1, 2, 3, 8), (8, 9), (9, 30))], found[1])
    empty = inc.limit(0)
    assert reductions.undo_gyo(tree.limit(0), empty, *reductions.gyo_logged(empty)).count() == 0


def test_intervals(spark):
    rng, rows = random.Random(3), []
    for g in range(12):
        ids = rng.sample(range(-5, 60), rng.randint(1, 40))
        for i, n in enumerate(ids):
            rows.append((g, n, None if i == 0 or (g == 7 and i == 3) else ids[rng.randrange(i)], [1], [1]))
    got = {(r["g"], r["node"]): (r["first"], r["last"], r["depth"]) for r in trees.intervals(spark.createDataFrame(rows, TREE)).collect()}
    kids = {}
    for g, n, p, _, _ in rows:
        kids.setdefault((g, p), []).append(n)
    want = {}

    def walk(g, n, at, depth):
        end = at
        for c in sorted(kids.get((g, n), [])):
            end = walk(g, c, end + 1, depth + 1)
        want[g, n] = (at, end, depth)
        return end

    for g in range(12):
        at = 0
        for root in sorted(kids[g, None]):
            at = walk(g, root, at, 0) + 1
    assert got == want
    with pytest.raises(ValueError, match="circle"):
        trees.intervals(spark.createDataFrame([(1, 0, None, [1], [1]), (1, 1, 2, [1], [1]), (1, 2, 1, [1], [1])], TREE))


def test_deep_branching_tree(spark):
    """A spine of 20,000 nodes with a leaf at each: special condition, reroot and depths with rows linear in the nodes."""
    n = 20_000
    tree = spark.range(0, 2 * n).selectExpr("1L AS g", "int(id) AS node", f"CASE WHEN id >= {n} THEN int(id - {n}) WHEN id > 0 THEN int(id - 1) END AS parent", "array(id) AS bag", "array(id) AS cover")
    spans = trees.intervals(tree)
    deepest = spans.where(f"node = {n - 1}").first()
    assert spans.count() == 2 * n and deepest["depth"] == n - 1 and deepest["last"] == deepest["first"] + 1
    turned = trees.reroot(tree, spark.createDataFrame([(1, 2 * n - 1)], "g long, node int"))
    assert turned.where(f"node < {n - 1} AND parent = node + 1").count() == n - 1 and turned.where("parent IS NULL").first()["node"] == 2 * n - 1
    inc = spark.range(0, 2 * n).selectExpr("1L AS g", "id AS e", "id AS v").union(spark.createDataFrame([(1, 0, 2 * n - 1)], "g long, e long, v long"))
    assert [r["special_condition"] for r in trees.special_condition(tree, inc).collect()] == [False]
    up = spark.range(0, 2 * n).selectExpr("1L AS g", "id AS e", "id AS v").union(spark.createDataFrame([(1, 2 * n - 1, 0)], "g long, e long, v long"))
    assert [r["special_condition"] for r in trees.special_condition(tree, up).collect()] == [True]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_covers(spark, most):
    rng, rows, conn, comps, graphs = random.Random(most), [], [], [], {}
    for g in range(25):
        n = rng.randint(3, 8)
        edges = [frozenset(rng.sample(range(1, n + 1), rng.randint(1, min(3, n)))) for _ in range(rng.randint(1, 9))]
        want, part = frozenset(rng.sample(range(1, n + 2), rng.randint(1, 4))), frozenset(rng.sample(range(1, n + 1), 2))
        graphs[g] = edges, want, part
        rows += [(g, e, v) for e, vs in enumerate(edges, 1) for v in vs]
        conn += [(g, v) for v in want]
        comps += [(g, v) for v in part]
    inc, conn, part = spark.createDataFrame(rows, "g long, e long, v long").cache(), spark.createDataFrame(conn, "g long, v long"), spark.createDataFrame(comps, "g long, v long")

    def plain(beyond, inside):
        out, combos = set(), 0
        for g, (edges, want, comp) in graphs.items():
            order = sorted((e for e, vs in enumerate(edges, 1) if vs & want), key=lambda e: (-len(edges[e - 1] & want), e))
            for k in range(1, most + 1):
                combos += comb(len(order), k)
                for some in combinations(order, k):
                    if not want <= set().union(*(edges[e - 1] for e in some)):
                        continue
                    if not beyond and k > 1 and want <= set().union(*(edges[e - 1] for e in some[:-1])):
                        continue
                    if inside and not any(edges[e - 1] & (comp - want) for e in some):
                        continue
                    out.add((g, ",".join(map(str, sorted(some))), k))
        return out, combos

    for beyond, inside in ((True, False), (False, False), (True, True), (False, True)):
        got = [tuple(r) for r in components.covers(inc, conn, most, beyond, part if inside else None).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(beyond, inside)[0]
    made = sum(frame.count() for frame in components.cover_levels(inc, conn, most, beyond=False))
    assert made < plain(True, False)[1]
