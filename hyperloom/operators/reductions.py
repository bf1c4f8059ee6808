"""Reductions that keep the width, and their inverses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.operators import packed, small_trees
from hyperloom.operators.incidence import edge_lists, vertex_degree
from hyperloom.operators.trees import bag_rows
from hyperloom.storage import cut, until_stable


def shared_parts(inc: DataFrame, whole: bool = True) -> DataFrame:
    """(g, e, vs, lone, v, degree) of distinct rows: the vertices of each edge that other edges have too, sorted; whether it has others; its rarest shared vertex.

    With ``whole`` false the other vertices count as removed already. Edges without shared vertices have no row: they neither are inside others nor hold any.
    """
    degrees = inc.groupBy("g", "v").agg(F.count("*").alias("degree"))
    if not whole:
        degrees = degrees.where("degree > 1")
    edges = inc.join(degrees, ["g", "v"]).groupBy("g", "e").agg(
        F.array_sort(F.collect_list(F.when(F.col("degree") > 1, F.col("v")))).alias("vs"),
        (F.min("degree") == 1).alias("lone"),
        F.min(F.when(F.col("degree") > 1, F.struct("degree", "v"))).alias("rare"),
    )
    return edges.where("size(vs) > 0").select("g", "e", "vs", "lone", "rare.v", "rare.degree")


def inside_others(parts: DataFrame) -> DataFrame:
    """(g, e, e2, vs, vs2, more): edges e of ``shared_parts`` inside others e2; of equal edges the one with the largest id is inside none.

    An edge inside another meets it at each of its vertices, so candidates are looked for at its rarest one alone; one with a vertex of its own is inside none.
    """
    meet = parts.where("NOT lone").select("g", "v", "e", "vs").join(parts.select("g", F.col("e").alias("e2"), F.explode("vs").alias("v")), ["g", "v"]).where("e != e2")
    both = meet.select("g", "e", "e2", "vs").join(parts.select("g", F.col("e").alias("e2"), F.col("vs").alias("vs2"), F.col("lone").alias("more")), ["g", "e2"])
    larger = both.where("size(vs2) > size(vs) OR (size(vs2) = size(vs) AND (more OR e2 > e))")
    return larger.where("size(array_except(vs, vs2)) = 0")


def subsumed_edges(inc: DataFrame) -> DataFrame:
    """(g, e, parent): edges inside another; of equal edges the one with the largest id stays. parent is the largest such edge's id."""
    inside = inside_others(shared_parts(inc.select("g", "e", "v").distinct()))
    arity = inc.groupBy("g", F.col("e").alias("e2")).agg(F.count_distinct("v").alias("n"))
    return inside.join(arity, ["g", "e2"]).groupBy("g", "e").agg(F.max(F.struct("n", "e2"))["e2"].alias("parent"))


def remove_subsumed(inc: DataFrame) -> DataFrame:
    return inc.join(subsumed_edges(inc), ["g", "e"], "left_anti")


def lonely_vertices(inc: DataFrame) -> DataFrame:
    return vertex_degree(inc).where("degree = 1").select("g", "v")


def remove_lonely(inc: DataFrame) -> DataFrame:
    return inc.join(lonely_vertices(inc), ["g", "v"], "left_anti")


def gyo_step(inc: DataFrame, whole: bool) -> DataFrame:
    """Distinct rows without lonely vertices and subsumed edges; with ``whole`` edges are compared with their lonely vertices, else without."""
    parts = cut(shared_parts(inc, whole), "shared-parts")
    left = parts.join(inside_others(parts).select("g", "e"), ["g", "e"], "left_anti")
    return left.select("g", "e", F.explode("vs").alias("v"))


def gyo_round(inc: DataFrame) -> DataFrame:
    """Distinct rows without subsumed edges, then without vertices that are lonely in what is left."""
    return remove_lonely(cut(gyo_step(inc, True), "unsubsumed"))


def gyo(inc: DataFrame) -> DataFrame:
    """The residue of removing subsumed edges and lonely vertices until nothing changes; empty for acyclic graphs.

    Small graphs are reduced as rows (``packed``). By joins, lonely vertices are dropped on the way to the comparison of edges, so that only shared ones are compared and written.
    """
    return cut(packed.over_graphs(inc, packed.residual_rows, "e long, v long", _gyo_by_joins), "gyo")


def _gyo_by_joins(inc: DataFrame) -> DataFrame:
    rows = cut(inc.distinct(), "rows")
    return until_stable(gyo_step(rows, True), lambda rows: gyo_step(rows, False), "gyo")


def gyo_logged(inc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``gyo``'s residue, and its log (g, e, parent) of each edge removed: an edge that held what was left of it then and stays for that round, or null where nothing was left to share.

    Vertices need no rows: an edge lost those that ``inc`` has and the residue has not.
    """
    both = cut(packed.over_graphs(inc, packed.logged_rows, "e long, v long, parent long", _logged_by_joins), "gyo-logged")
    return both.where("v IS NOT NULL").select("g", "e", "v"), both.where("v IS NULL").select("g", "e", "parent")


def _logged_by_joins(inc: DataFrame) -> DataFrame:
    """(g, e, v, parent): the residue's rows without a parent, and the log's without a vertex."""
    rows, whole, log = cut(inc.distinct(), "rows"), True, None
    before = rows.count()
    while True:
        parts = cut(shared_parts(rows, whole), "shared-parts")
        # Holding is transitive, so the largest holder is in none itself.
        held = inside_others(parts).groupBy("g", "e").agg(F.max(F.struct(F.size("vs2").alias("n"), "more", "e2"))["e2"].alias("parent"))
        alone = rows.select("g", "e").distinct().join(parts, ["g", "e"], "left_anti").withColumn("parent", F.lit(None).cast("long"))
        gone = cut(held.union(alone), "gyo-log")
        log = gone if log is None else log.union(gone)
        rows = cut(parts.join(gone, ["g", "e"], "left_anti").select("g", "e", F.explode("vs").alias("v")), "gyo")
        after = rows.count()
        if after == before and not whole:
            none = F.lit(None).cast("long")
            return rows.withColumn("parent", none).unionByName(log.withColumn("v", none))
        before, whole = after, False


def undo_gyo(tree: DataFrame, inc: DataFrame, residue: DataFrame, log: DataFrame) -> DataFrame:
    """Trees of ``inc`` from trees of the residue, both (g, node, parent, bag, cover): the log undone in one plan, whatever its number of rounds.

    Each edge has a node in the end that holds all its vertices. For an edge of the residue that is a node with the residual edge, whose bag takes up the lost vertices if its cover has the edge; else
    a leaf below it has them. A removed edge is a leaf below the node of its parent, and one without a parent hangs from the root. What an edge shared when it was removed
    is in its parent, so each vertex keeps one subtree; new nodes have one edge as cover, so the width grows to 1 at most. Where the residue is empty a join tree arises from the log alone.
    Graphs with a residue but without a tree, or with a tree that does not hold some residual edge, have no rows. Small graphs are undone as rows (``packed``).
    """
    fields = "node int, parent int, bag array<bigint>, cover array<bigint>"
    frames = {
        "tree": tree.select("g", F.col("node").cast("int").alias("node"), F.col("parent").cast("int").alias("parent"), "bag", "cover"),
        "inc": inc.select("g", "e", "v"), "residue": residue.select("g", "e", "v"), "log": log.select("g", "e", "parent"),
    }
    return packed.together(frames, small_trees.undone_rows, fields, _undo_by_joins)


def _undo_by_joins(tree: DataFrame, inc: DataFrame, residue: DataFrame, log: DataFrame) -> DataFrame:
    own = edge_lists(inc)
    size = residue.groupBy("g", "e").agg(F.count_distinct("v").alias("n"))
    holding = residue.select("g", "e", "v").distinct().join(bag_rows(tree), ["g", "v"]).groupBy("g", "e", "node").agg(F.count("*").alias("m")).join(size, ["g", "e"]).where("m = n")
    named = tree.select("g", "node", F.explode("cover").alias("e")).distinct().withColumn("named", F.lit(True))
    home = holding.join(named, ["g", "node", "e"], "left").groupBy("g", "e").agg(F.min(F.struct(F.col("named").isNull().alias("bare"), "node")).alias("x")).select("g", "e", "x.bare", "x.node")
    kept = cut(size.join(home, ["g", "e"], "left").join(own, ["g", "e"]).select("g", "e", "node", "bare", "vertices", (F.size("vertices") > F.col("n")).alias("lost")), "residual-edges")
    lacking = kept.where("node IS NULL").select("g").distinct()
    tree = cut(tree.join(lacking, "g", "left_anti").join(kept.select("g"), "g", "left_semi").select("g", F.col("node").cast("int").alias("node"), F.col("parent").cast("int").alias("parent"), "bag", "cover"), "residual-trees")
    kept = kept.join(lacking, "g", "left_anti")
    gone = log.join(lacking, "g", "left_anti").select("g", "e", "parent", F.lit(None).cast("int").alias("below"))
    fresh = gone.union(kept.where("lost AND bare").select("g", "e", F.lit(None).cast("long"), F.col("node").cast("int")))
    tops = tree.groupBy("g").agg(F.max("node").alias("top"), F.min(F.when(F.col("parent").isNull(), F.col("node"))).alias("root"))
    # Edges without a parent come first, so that the first of them is the root where the residue is empty.
    order = Window.partitionBy("g").orderBy(F.desc(F.col("parent").isNull() & F.col("below").isNull()), "e")
    leaves = fresh.withColumn("pos", F.row_number().over(order)).join(tops, "g", "left").withColumn("node", F.coalesce(F.col("top") + F.col("pos"), F.col("pos") - 1).cast("int"))
    leaves = cut(leaves.select("g", "e", "node", "parent", "below", F.coalesce("root", F.lit(0)).alias("root")), "leaves")
    places = leaves.select("g", F.col("e").alias("parent"), F.col("node").alias("place")).union(kept.where("NOT (lost AND bare)").select("g", "e", F.col("node").cast("int")))
    up = F.when(F.col("parent").isNotNull(), F.col("place")).when(F.col("below").isNotNull(), F.col("below")).when(F.col("node") != F.col("root"), F.col("root"))
    new = leaves.join(places, ["g", "parent"], "left").join(own, ["g", "e"]).select("g", "node", up.alias("parent"), F.col("vertices").alias("bag"), F.array("e").alias("cover"))
    more = kept.where("lost AND NOT bare").groupBy("g", F.col("node").cast("int").alias("node")).agg(F.flatten(F.collect_list("vertices")).alias("more"))
    grown = tree.join(more, ["g", "node"], "left").select("g", "node", "parent", F.when(F.col("more").isNotNull(), F.array_sort(F.array_union("bag", "more"))).otherwise(F.col("bag")).alias("bag"), "cover")
    return grown.union(new)


def acyclic(inc: DataFrame, residue: DataFrame) -> DataFrame:
    left = residue.groupBy("g").agg(F.count_distinct("e").alias("n"))
    return inc.select("g").distinct().join(left, "g", "left").select("g", F.col("n").isNull().alias("is_acyclic"), F.coalesce("n", F.lit(0)).alias("residual_edges"))


def type_collapse(inc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(incidence of representatives, (g, rep, v)): vertices in the same edges become the smallest of them."""
    types = inc.groupBy("g", "v").agg(F.array_sort(F.collect_set("e")).alias("edges"))
    reps = types.groupBy("g", "edges").agg(F.min("v").alias("rep"))
    members = types.join(reps, ["g", "edges"]).select("g", "rep", "v")
    kept = inc.join(members.where("v = rep").select("g", "v"), ["g", "v"], "left_semi").select("g", "e", "v")
    return kept, members


def restore_types(kept: DataFrame, members: DataFrame) -> DataFrame:
    """All vertices again, in every edge that has their representative."""
    return kept.select("g", "e", F.col("v").alias("rep")).join(members, ["g", "rep"]).select("g", "e", "v")
