"""Repair of trees: each kind of damage has its outcome, and what comes back is valid."""

import random

from pyspark.sql import functions as F

from hyperloom.operators import frontier, reductions, repair, trees

TREE = "g long, node int, parent int, bag array<long>, cover array<long>"


def test_outcomes(spark):
    rng, graphs = random.Random(4), {}
    for g in range(60):
        n = rng.randint(4, 10)
        ring = [frozenset((i, i % n + 1)) for i in range(1, n + 1)]
        graphs[g] = ring + [frozenset((rng.randint(1, n), 20 + k, 40 + k)) for k in range(rng.randint(1, 3))] + [frozenset((1,))]
    inc = spark.createDataFrame([(g, e, v) for g, edges in graphs.items() for e, vs in enumerate(edges, 1) for v in vs], "g long, e long, v long").cache()
    kept, members = reductions.type_collapse(inc)
    residue, log = reductions.gyo_logged(kept.cache())
    small = frontier.trees_of(*frontier.solve(residue, 2), 2).cache()
    whole = trees.restore_types_in_bags(reductions.undo_gyo(small, kept, residue, log), members).cache()
    assert small.select("g").distinct().count() == 60
    # A leaf with part of its parent's bag below each node, pruned away again.
    more = whole.select("g", (F.col("node") + 1000).alias("node"), F.col("node").alias("parent"), F.expr("slice(bag, 1, 1)").alias("bag"), "cover")
    least = whole.groupBy("g").agg(F.max("node").alias("node"))
    missing = whole.withColumn("bag", F.expr("filter(bag, v -> v < 40)"))
    circle = whole.union(least.select("g", F.lit(5000), F.lit(5001), F.array().cast("array<long>"), F.array().cast("array<long>")).union(least.select("g", F.lit(5001), F.lit(5000), F.array().cast("array<long>"), F.array().cast("array<long>"))))
    kinds = [whole.union(more), small, missing, circle, whole.withColumn("parent", F.when(F.col("parent").isNull(), 7777).otherwise(F.col("parent"))), whole.union(whole)]
    read = kinds[0].where("g % 6 = 0")
    for k, frame in enumerate(kinds[1:], 1):
        read = read.union(frame.where(F.col("g") % 6 == k).select("g", "node", "parent", "bag", "cover"))
    read = read.union(spark.createDataFrame([(900, 1, None, [1], [1]), (3, 6000, None, None, None)], TREE))
    outcomes, made = repair.repair(read, inc)
    got = {r["g"]: r["outcome"] for r in outcomes.collect()}
    names = {0: "pruned", 1: "lifted"}
    assert got == {g: names.get(g % 6, "broken") for g in graphs} | {900: "broken"}
    made = made.cache()
    assert {r["g"] for r in made.select("g").distinct().collect()} == {g for g in graphs if g % 6 < 2}
    assert all(r["valid"] and r["width"] <= 2 for r in trees.validate(made, inc).collect())
    up = made.select("g", F.col("node").alias("parent"), F.col("bag").alias("above"))
    assert made.where("g % 6 = 0").join(up, ["g", "parent"]).where("size(array_except(bag, above)) = 0").count() == 0


def test_deep_and_empty(spark):
    """A path of 3,000 nodes is well formed; the same with its end tied to its start is not; no rows give none."""
    path = [(1, n, n - 1 if n > 1 else None, [n, n + 1], [n]) for n in range(1, 3001)] + [(2, n, n - 1 if n > 1 else 3000, [n], [n]) for n in range(1, 3001)] + [(2, 4000, None, [], [])]
    tree = spark.createDataFrame(path, TREE)
    assert [r["g"] for r in repair.well_formed(tree).collect()] == [1]
    outcomes, made = repair.repair(spark.createDataFrame([], TREE), spark.createDataFrame([(1, 1, 1)], "g long, e long, v long"))
    assert outcomes.collect() == [] and made.collect() == []
