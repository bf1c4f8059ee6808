"""Trees read from elsewhere: checked, pruned, or lifted from the reduced graph to the whole one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.operators import packed, reductions, small_trees, trees
from hyperloom.storage import cut


def well_formed(tree: DataFrame) -> DataFrame:
    """(g): trees with one root, each node once, known parents, and no parents in a circle (pointers to ancestors double until all have passed the root)."""
    sizes = tree.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("node").alias("nodes"), F.sum(F.col("parent").isNull().cast("int")).alias("roots"))
    links = tree.where("parent IS NOT NULL").select("g", "node", "parent")
    orphans = links.join(tree.select("g", F.col("node").alias("parent")), ["g", "parent"], "left_anti")
    fine = cut(sizes.where("n = nodes AND roots = 1").select("g", "n").join(orphans, "g", "left_anti"), "shapes")
    jumps = cut(links.join(fine, "g", "left_semi"), "jumps")
    steps, most = 1, fine.agg(F.max("n")).first()[0] or 0
    while steps < most:
        # A node whose pointer has passed the root has no row any more.
        jumps = cut(jumps.join(jumps.select("g", F.col("node").alias("parent"), F.col("parent").alias("up")), ["g", "parent"]).select("g", "node", F.col("up").alias("parent")), "jumps")
        steps *= 2
    return fine.join(jumps, "g", "left_anti").select("g")


def _valid(tree: DataFrame, inc: DataFrame) -> DataFrame:
    checks = trees.bags_covered(tree, inc).join(trees.covers_known(tree, inc), "g").join(trees.edges_in_bags(tree, inc), "g").join(trees.connected(tree), "g")
    return checks.where("bags_covered AND covers_known AND edges_in_bags AND connected").select("g")


def repair(tree: DataFrame, inc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, outcome), and the trees (g, node, parent, bag, cover) of those not broken.

    'pruned': the tree is one of the graph; nodes inside their parents are contracted. 'lifted': it is one of what type collapse and the acyclicity reduction leave of the graph, and both are undone in it.
    'broken': neither, or no tree at all (see ``well_formed``), or a graph that ``inc`` does not have; one bad tree never stops the others. Null bags and covers count as empty. All are checked again at the end, and what fails then is broken.
    Small graphs are repaired as rows (``packed``), with the same steps.
    """
    none = F.expr("cast(array() as array<bigint>)")
    tree = tree.select("g", F.col("node").cast("int").alias("node"), F.col("parent").cast("int").alias("parent"), F.coalesce("bag", none).alias("bag"), F.coalesce("cover", none).alias("cover"))
    fields = "outcome string, node int, parent int, bag array<bigint>, cover array<bigint>"
    both = cut(packed.together({"tree": tree, "inc": inc.select("g", "e", "v")}, small_trees.repaired, fields, _repair_by_joins), "repaired")
    return both.select("g", "outcome").distinct(), both.where("node IS NOT NULL").select("g", "node", "parent", "bag", "cover")


def _repair_by_joins(tree: DataFrame, inc: DataFrame) -> DataFrame:
    """(g, outcome, node, parent, bag, cover), without a node where the tree is broken."""
    tree = cut(tree, "read-trees")
    shaped = cut(tree.join(well_formed(tree), "g", "left_semi").join(inc.select("g").distinct(), "g", "left_semi"), "shaped-trees")
    good = cut(_valid(shaped, inc), "good-trees")
    pruned = trees.prune(cut(shaped.join(good, "g", "left_semi"), "good-trees"))
    rest = cut(shaped.join(good, "g", "left_anti"), "other-trees")
    kept, members = reductions.type_collapse(inc.join(rest.select("g").distinct(), "g", "left_semi"))
    kept, members = cut(kept, "representatives"), cut(members, "members")
    residue, log = reductions.gyo_logged(kept)
    fits = cut(rest.join(_valid(rest, residue), "g", "left_semi"), "reduced-trees")
    mine = fits.select("g").distinct()
    lifted = reductions.undo_gyo(fits, *(frame.join(mine, "g", "left_semi") for frame in (kept, residue, log)))
    lifted = trees.restore_types_in_bags(lifted, members)
    made = cut(pruned.withColumn("outcome", F.lit("pruned")).unionByName(lifted.withColumn("outcome", F.lit("lifted"))), "repaired")
    made = cut(made.join(_valid(made, inc), "g", "left_semi"), "repaired")
    return tree.select("g").distinct().join(made, "g", "left").withColumn("outcome", F.coalesce("outcome", F.lit("broken")))
