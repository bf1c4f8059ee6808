"""Trees of small graphs as rows are checked, undone and repaired as by joins."""

import random

import pytest
from pyspark.sql import functions as F

from hyperloom.operators import distances, packed, reductions, repair, trees

TREE = "g long, node int, parent int, bag array<bigint>, cover array<bigint>"


def sort(frame):
    return sorted((tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def inc(spark):
    rng, rows = random.Random(8), []
    for g in range(40):
        n = rng.randint(2, 9)
        for e in range(1, rng.randint(2, 9)):
            rows += [(g, e * 7 % 13, v) for v in rng.sample(range(n), rng.randint(1, min(4, n)))]
    return spark.createDataFrame(rows, "g long, e long, v long").distinct().cache()


@pytest.fixture(scope="module")
def tree(spark, inc):
    """Random trees over the graphs' edges: bags with vertices too few, too many or null, unknown covers, covers of two edges, several roots."""
    rng, rows, edges = random.Random(9), [], {}
    for r in inc.collect():
        edges.setdefault(r["g"], {}).setdefault(r["e"], []).append(r["v"])
    for g, es in sorted(edges.items()):
        for k, (e, vs) in enumerate(sorted(es.items())):
            whole = sorted({v for some in es.values() for v in some})
            bag = rng.choice([sorted(vs), whole, sorted(vs)[1:], [*sorted(vs), 99], None] if g % 3 else [whole])
            rows.append((g, k, rng.randrange(k) if k and rng.random() < 0.95 else None, bag, rng.choice([[e], [e, min(es)], [-1], sorted(es)] if g % 3 else [sorted(es)])))
    return spark.createDataFrame(rows, TREE).cache()


def test_checks_and_repair_equal_joins(spark, inc, tree, monkeypatch):
    calls = []
    monkeypatch.setattr(trees, "_validate_by_joins", lambda *a, f=trees._validate_by_joins: calls.append(1) or f(*a))
    runs = {"checks": lambda: sort(trees.validate(tree, inc)), "outcomes": lambda: sort(repair.repair(tree, inc)[0]), "repaired": lambda: sort(repair.repair(tree, inc)[1])}
    got = {name: run() for name, run in runs.items()}
    assert not calls
    monkeypatch.setattr(packed, "MOST", 0)
    for name, run in runs.items():
        assert got[name] == run(), name
    assert calls and len(set(got["checks"])) > 10


def test_undone_reduction_equals_joins(inc, monkeypatch):
    kept, members = reductions.type_collapse(inc)
    residue, log = reductions.gyo_logged(kept)
    one = residue.groupBy("g").agg(F.array_sort(F.collect_set("v")).alias("bag"), F.array_sort(F.collect_set("e")).alias("cover")).withColumn("node", F.lit(0)).withColumn("parent", F.lit(None).cast("int"))
    # Every fourth tree does not hold its residue, every fifth names no edge.
    one = one.withColumn("bag", F.expr("CASE WHEN g % 4 = 0 THEN slice(bag, 2, 9) ELSE bag END")).withColumn("cover", F.expr("CASE WHEN g % 5 = 0 THEN slice(cover, 2, 9) ELSE cover END"))
    run = lambda: sort(trees.restore_types_in_bags(reductions.undo_gyo(one, kept, residue, log), members))
    got = run()
    monkeypatch.setattr(packed, "MOST", 0)
    assert got == run() and len(got) > 100


def test_lifted_trees_are_repaired_as_by_joins(inc, monkeypatch):
    residue, _ = reductions.gyo_logged(reductions.type_collapse(inc)[0])
    one = residue.groupBy("g").agg(F.array_sort(F.collect_set("v")).alias("bag"), F.array_sort(F.collect_set("e")).alias("cover")).select("g", F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), "bag", "cover")
    run = lambda: [sort(f) for f in repair.repair(one, inc)]
    got = run()
    monkeypatch.setattr(packed, "MOST", 0)
    assert got == run() and any("lifted" in r for r in got[0])


def test_distances_equal_joins(inc, monkeypatch):
    calls = []
    monkeypatch.setattr(distances, "_distances_by_joins", lambda *a, f=distances._distances_by_joins: calls.append(1) or f(*a))
    got = sort(distances.primal_distances(inc))
    assert got and not calls
    monkeypatch.setattr(packed, "MOST", 0)
    assert got == sort(distances.primal_distances(inc)) and calls
