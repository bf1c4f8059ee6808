"""Hinge trees by joins: graphs split at single edges that leave several components, solved part by part, and the trees of the parts grafted together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.operators import components, packed, trees
from hyperloom.storage import cut


def edge_separators(inc: DataFrame) -> DataFrame:
    """(g, x, e, comp): ``components`` without the vertices of edge x, for the edges x that leave more than one, all of them tested in one plan."""
    seps = inc.select("g", F.col("e").alias("s"), "v").distinct()
    found = components.components(inc.select("g", "e", "v").distinct(), seps)
    several = found.groupBy("g", "s").agg((F.min("comp") != F.max("comp")).alias("several")).where("several").select("g", "s")
    return cut(found.join(several, ["g", "s"], "left_semi").select("g", F.col("s").alias("x"), "e", "comp"), "edge-separators")


def hinge_tree(inc: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(g, part, parent, shared, e): the edges of each part, from part 0, and the edge that a part shares with its parent; a graph that no edge separates is one part.

    In a part, what an edge separates is what it separates in the whole graph, cut down to the part: a way through another part enters and leaves it by the vertices of the shared edge, which is in
    both. So ``edge_separators`` are found once (or given as ``labels``), and each level only joins them with the parts. A level splits each part at the edge whose largest piece is smallest (then the lowest id):
    the piece with the edge shared with the parent, or else with the lowest edge, stays; any other becomes a part named by (x, comp), with a copy of x. Each edge splits one part, once, so the name tells it, and
    the parent is the part that has x itself and no copy. Edges inside x stay. The number of edges in the largest part does not depend on the choice of edges; the number of levels does: it is
    logarithmic for trees of small parts, but one large part with many small ones at different edges loses one of them a level. Without ``labels`` small graphs are split as rows (``packed``).
    """
    if labels is None:
        return packed.over_graphs(inc, packed.hinge_rows, "part int, parent int, shared long, e long", lambda rows: hinge_tree(rows, edge_separators(rows)))
    edges = inc.select("g", "e").distinct()
    root = F.lit(None).cast("long")
    parts = cut(edges.select("g", root.alias("px"), root.alias("pc"), "e", F.lit(True).alias("own")), "hinge-parts")
    waiting, done = parts, []
    while True:
        inside = waiting.select("g", "px", "pc", F.col("e").alias("x")).join(labels, ["g", "x"])
        here = waiting.select("g", F.col("px").alias("qx"), F.col("pc").alias("qc"), "e")
        same = F.col("px").eqNullSafe(F.col("qx")) & F.col("pc").eqNullSafe(F.col("qc"))
        rows = cut(inside.join(here, ["g", "e"]).where(same).select("g", "px", "pc", "x", "e", "comp"), "hinge-labels")
        pieces = rows.groupBy("g", "px", "pc", "x", "comp").agg(F.count("*").alias("n"), F.max(F.col("e").eqNullSafe(F.col("px"))).alias("shared"))
        best = pieces.groupBy("g", "px", "pc", "x").agg(F.count("*").alias("pieces"), F.max("n").alias("n"), F.min("comp").alias("first"), F.min(F.when(F.col("shared"), F.col("comp"))).alias("shared"))
        picked = best.where("pieces > 1").groupBy("g", "px", "pc").agg(F.min(F.struct("n", "x", F.coalesce("shared", "first").alias("home"))).alias("k"))
        picked = cut(picked.select("g", F.col("px").alias("qx"), F.col("pc").alias("qc"), "k.x", "k.home"), "hinge-splits")
        if picked.isEmpty():
            break
        at = ["g", F.col("px").eqNullSafe(F.col("qx")) & F.col("pc").eqNullSafe(F.col("qc"))]
        done.append(waiting.join(picked.withColumnRenamed("g", "h"), (F.col("g") == F.col("h")) & at[1], "left_anti"))
        split = waiting.join(picked.withColumnRenamed("g", "h"), (F.col("g") == F.col("h")) & at[1]).drop("h", "qx", "qc")
        told = split.join(labels, ["g", "x", "e"], "left").withColumn("moved", F.col("comp").isNotNull() & (F.col("comp") != F.col("home")))
        stay = told.select("g", F.when(F.col("moved"), F.col("x")).otherwise(F.col("px")).alias("px"), F.when(F.col("moved"), F.col("comp")).otherwise(F.col("pc")).alias("pc"), "e", "own")
        copies = told.where("moved").select("g", F.col("x").alias("px"), F.col("comp").alias("pc"), F.col("x").alias("e"), F.lit(False).alias("own")).distinct()
        waiting = cut(stay.union(copies), "hinge-parts")
    whole = waiting
    for frame in done:
        whole = whole.union(frame)
    names = whole.select("g", "px", "pc").distinct().withColumn("part", F.row_number().over(Window.partitionBy("g").orderBy(F.asc_nulls_first("px"), "pc")) - 1)
    named = cut(
        whole.join(names.withColumnsRenamed({"px": "qx", "pc": "qc"}), "g").where(F.col("px").eqNullSafe(F.col("qx")) & F.col("pc").eqNullSafe(F.col("qc"))).select("g", "part", F.col("px").alias("shared"), "e", "own"), "hinge-tree"
    )
    homes = named.where("own").select("g", F.col("e").alias("shared"), F.col("part").alias("parent"))
    return named.join(homes, ["g", "shared"], "left").select("g", "part", "parent", "shared", "e")


def largest_hinge(tree: DataFrame) -> DataFrame:
    """(g, part, edges): the part of ``hinge_tree`` with most edges; of equal ones the first."""
    sizes = tree.groupBy("g", "part").agg(F.count("*").alias("edges"))
    return sizes.groupBy("g").agg(F.max_by("part", F.struct("edges", -F.col("part"))).alias("part"), F.max("edges").alias("edges"))


def part_graphs(tree: DataFrame, inc: DataFrame) -> DataFrame:
    """Incidence rows of the parts as graphs of their own, named by the struct (g, part)."""
    return tree.select("g", "part", "e").join(inc, ["g", "e"]).select(F.struct("g", "part").alias("g"), "e", "v")


def graft(tree: DataFrame, solved: DataFrame, inc: DataFrame) -> DataFrame:
    """Trees (g, node, parent, bag, cover) of the whole graphs from those of their parts, whose g is (g, part); graphs of which a part has no tree have no rows.

    Every part is rerooted at its first node with the edge that it shares with its parent, and hung from the parent's first such node, all parts in one plan: neither depends on other parts. A root
    whose bag is inside that node's is left out, and its children hang from the node.
    """
    parts = cut(tree.select("g", "part", "parent", "shared").distinct(), "hinge-links")
    lists = inc.groupBy("g", F.col("e").alias("shared")).agg(F.array_sort(F.collect_set("v")).alias("vertices"))
    lacking = parts.select(F.struct("g", "part").alias("x"), "g").join(solved.select(F.col("g").alias("x")).distinct(), "x", "left_anti").select("g").distinct()
    links = cut(parts.where("shared IS NOT NULL").join(lacking, "g", "left_anti").join(lists, ["g", "shared"]), "hinge-links")
    wanted = links.select(F.struct("g", "part").alias("g"), "vertices")
    turned = trees.reroot_covering(solved.join(wanted, "g", "left_semi"), wanted)
    tops = solved.join(wanted, "g", "left_anti")
    # A part that no node of its own connects to its parent has no root left to hang; that cannot be a tree of the part.
    every = cut(turned.union(tops).select("g.g", "g.part", "node", "parent", "bag", "cover").join(lacking, "g", "left_anti"), "hinge-trees")
    above = every.select("g", F.col("part").alias("up"), F.col("node").alias("at"), F.col("bag").alias("held"))
    places = links.select("g", "part", F.col("parent").alias("up"), "vertices").join(above, ["g", "up"]).where(F.size(F.array_except("vertices", "held")) == 0)
    places = places.groupBy("g", "part", "up").agg(F.min(F.struct("at", "held")).alias("k")).select("g", "part", "up", "k.at", "k.held")
    roots = every.where("parent IS NULL").join(places, ["g", "part"]).select("g", "part", "node", "up", "at", F.size(F.array_except("bag", "held")).alias("beyond"))
    roots = cut(roots, "hinge-roots")
    gone = roots.where("beyond = 0").select("g", "part", F.col("node").alias("parent"))
    # A node that is left out passes on what hangs from it, over several parts if need be; parts nest no deeper than the tree.
    hangs = roots.select("g", "part", "node", "up", "at")
    while True:
        drop = roots.where("beyond = 0").select("g", F.col("part").alias("up"), F.col("node").alias("at")).join(hangs.select("g", F.col("part").alias("up"), F.col("node").alias("at"), F.col("up").alias("up2"), F.col("at").alias("at2")), ["g", "up", "at"])
        on = hangs.join(drop, ["g", "up", "at"], "left")
        if on.where("up2 IS NOT NULL").isEmpty():
            break
        hangs = cut(on.select("g", "part", "node", F.coalesce("up2", "up").alias("up"), F.coalesce("at2", "at").alias("at")), "hinge-hangs")
    inner = every.where("parent IS NOT NULL").join(gone.withColumn("out", F.lit(True)), ["g", "part", "parent"], "left")
    by_part = hangs.select("g", "part", F.col("up").alias("hang_part"), F.col("at").alias("hang_node"))
    moved = inner.join(by_part, ["g", "part"], "left").select(
        "g", "part", "node", F.when(F.col("out"), F.col("hang_part")).otherwise(F.col("part")).alias("above"), F.when(F.col("out"), F.col("hang_node")).otherwise(F.col("parent")).alias("parent"), "bag", "cover"
    )
    heads = every.where("parent IS NULL").join(gone.withColumnRenamed("parent", "node"), ["g", "part", "node"], "left_anti").join(by_part, ["g", "part"], "left")
    moved = moved.union(heads.select("g", "part", "node", F.col("hang_part").alias("above"), F.col("hang_node").alias("parent"), "bag", "cover"))
    ids = cut(moved.withColumn("id", F.row_number().over(Window.partitionBy("g").orderBy("part", "node"))), "hinge-nodes")
    up = ids.select("g", F.col("part").alias("above"), F.col("node").alias("parent"), F.col("id").alias("to"))
    return ids.join(up, ["g", "above", "parent"], "left").select("g", F.col("id").alias("node"), F.col("to").alias("parent"), "bag", "cover")
