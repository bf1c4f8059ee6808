"""Decomposition trees as rows (g, node, parent, bag, cover): checks and changes by joins.

``cover`` holds edge ids; a root's parent is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.operators import packed, small_trees
from hyperloom.storage import cut


def bag_rows(tree: DataFrame) -> DataFrame:
    return tree.select("g", "node", F.explode("bag").alias("v")).distinct()


def cover_rows(tree: DataFrame, inc: DataFrame) -> DataFrame:
    """(g, node, v) of the cover edges' vertices; cover ids that are no edges of the graph give none."""
    return tree.select("g", "node", F.explode("cover").alias("e")).join(inc, ["g", "e"]).select("g", "node", "v").distinct()


def width(tree: DataFrame) -> DataFrame:
    return tree.groupBy("g").agg(F.max(F.size("cover")).alias("width"))


def _graphs(tree: DataFrame) -> DataFrame:
    return tree.select("g").distinct()


def _fails(graphs: DataFrame, bad: DataFrame, name: str) -> DataFrame:
    return graphs.join(bad.select("g").distinct().withColumn("bad", F.lit(True)), "g", "left").select("g", F.col("bad").isNull().alias(name))


def bags_covered(tree: DataFrame, inc: DataFrame) -> DataFrame:
    return _fails(_graphs(tree), bag_rows(tree).join(cover_rows(tree, inc), ["g", "node", "v"], "left_anti"), "bags_covered")


def covers_known(tree: DataFrame, inc: DataFrame) -> DataFrame:
    """Every cover edge is an edge of the graph."""
    named = tree.select("g", F.explode("cover").alias("e"))
    return _fails(_graphs(tree), named.join(inc.select("g", "e").distinct(), ["g", "e"], "left_anti"), "covers_known")


def edges_in_bags(tree: DataFrame, inc: DataFrame) -> DataFrame:
    size = inc.groupBy("g", "e").agg(F.count_distinct("v").alias("arity"))
    inside = inc.join(bag_rows(tree), ["g", "v"]).groupBy("g", "e", "node").agg(F.count_distinct("v").alias("n"))
    held = inside.join(size, ["g", "e"]).where("n = arity").select("g", "e").distinct()
    return _fails(_graphs(tree), size.join(held, ["g", "e"], "left_anti"), "edges_in_bags")


def connected(tree: DataFrame) -> DataFrame:
    """The nodes of each vertex form one subtree: in a forest, nodes less links is the number of trees."""
    bags = bag_rows(tree)
    links = tree.where("parent IS NOT NULL").select("g", "node", "parent")
    shared = bags.join(links, ["g", "node"]).join(bags.select("g", F.col("node").alias("parent"), "v"), ["g", "parent", "v"]).groupBy("g", "v").agg(F.count("*").alias("links"))
    nodes = bags.groupBy("g", "v").agg(F.count("*").alias("nodes"))
    return _fails(_graphs(tree), nodes.join(shared, ["g", "v"], "left").where("nodes - coalesce(links, 0) != 1"), "connected")


def ancestors(tree: DataFrame) -> DataFrame:
    """(g, top, node): every node under every node, itself included; doubling, so a round for each bit of the depth, whatever it is."""
    known = cut(tree.select("g", F.col("node").alias("top"), "node").union(tree.where("parent IS NOT NULL").select("g", F.col("parent").alias("top"), "node")), "ancestors")
    before = known.count()
    while True:
        known = cut(known.join(known.select("g", F.col("top").alias("node"), F.col("node").alias("low")), ["g", "node"]).select("g", "top", F.col("low").alias("node")).distinct(), "ancestors")
        after = known.count()
        if after == before:
            return known
        before = after


def intervals(tree: DataFrame) -> DataFrame:
    """(g, node, first, last, depth): nodes numbered from 0 in preorder, those below a node from first + 1 to last; siblings and roots by id.

    A list ranking of the tour that enters and leaves each node: every event points to the next one, pointers double, and the entries up to the end are summed on the way. So there are two rows a
    node and a round for each bit of their number, however deep a tree is. Parents in a circle are an error.
    """
    kids = tree.where("parent IS NOT NULL").groupBy("g", F.col("parent").alias("node")).agg(F.min("node").alias("kid"))
    beside = tree.select("g", "node", "parent", F.lead("node").over(Window.partitionBy("g", "parent").orderBy("node")).alias("sibling"))
    enter, leave = (lambda c: F.col(c).cast("long") * 2), (lambda c: F.col(c).cast("long") * 2 + 1)
    enters = tree.select("g", "node").join(kids, ["g", "node"], "left").select("g", enter("node").alias("at"), F.coalesce(enter("kid"), leave("node")).alias("next"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("d"))
    leaves = beside.select("g", leave("node").alias("at"), F.coalesce(enter("sibling"), leave("parent")).alias("next"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d"))
    tour, before = cut(enters.union(leaves), "tour"), None
    while True:
        open_ = tour.where("next IS NOT NULL").count()
        if not open_:
            break
        if open_ == before:
            raise ValueError("parents of a tree go round in a circle")
        ahead = tour.select("g", F.col("at").alias("next"), F.col("next").alias("after"), F.col("n").alias("more"), F.col("d").alias("deeper"))
        joined = tour.join(ahead, ["g", "next"], "left")
        tour = cut(joined.select("g", "at", F.col("after").alias("next"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), (F.col("d") + F.coalesce("deeper", F.lit(0))).alias("d")), "tour")
        before = open_
    sums = tour.groupBy("g", F.expr("floor(at / 2)").alias("at")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("n"))).alias("own"), F.max(F.when(F.col("at") % 2 != 0, F.col("n"))).alias("rest"), F.max(F.when(F.col("at") % 2 == 0, -F.col("d"))).alias("depth"))
    total = tree.groupBy("g").agg(F.count("*").alias("nodes"))
    numbers = sums.join(total, "g").select("g", F.col("at").alias("node"), (F.col("nodes") - F.col("own")).alias("first"), (F.col("nodes") - F.col("rest") - 1).alias("last"), F.col("depth").cast("int").alias("depth"))
    return cut(numbers.withColumn("node", F.col("node").cast(tree.schema["node"].dataType)), "intervals")


def special_condition(tree: DataFrame, inc: DataFrame) -> DataFrame:
    """Cover vertices missing from a node's bag do not occur below it: the next number of a node with the vertex is past the interval of the node that misses it."""
    spans = intervals(tree)
    missing = cover_rows(tree, inc).join(bag_rows(tree), ["g", "node", "v"], "left_anti").join(spans, ["g", "node"]).select("g", "v", "first", "last")
    there = bag_rows(tree).join(spans, ["g", "node"]).select("g", "v", "first", F.lit(None).cast("long").alias("last"))
    after = F.min(F.when(F.col("last").isNull(), F.col("first"))).over(Window.partitionBy("g", "v").orderBy(F.desc("first")).rowsBetween(Window.unboundedPreceding, 0))
    return _fails(_graphs(tree), missing.union(there).withColumn("after", after).where("after <= last"), "special_condition")


def validate(tree: DataFrame, inc: DataFrame) -> DataFrame:
    """(g, width, one column for each check, valid): valid is that of a generalised decomposition. Small graphs are checked as rows (``packed``), with their trees."""
    fields = "width int, bags_covered boolean, covers_known boolean, edges_in_bags boolean, connected boolean, special_condition boolean, valid boolean"
    frames = {"tree": tree.select("g", "node", "parent", "bag", "cover"), "inc": inc.select("g", "e", "v")}
    return packed.together(frames, small_trees.validated, fields, _validate_by_joins)


def _validate_by_joins(tree: DataFrame, inc: DataFrame) -> DataFrame:
    out = width(tree).join(bags_covered(tree, inc), "g").join(covers_known(tree, inc), "g").join(edges_in_bags(tree, inc), "g").join(connected(tree), "g").join(special_condition(tree, inc), "g")
    return out.withColumn("valid", F.col("bags_covered") & F.col("covers_known") & F.col("edges_in_bags") & F.col("connected"))


def reroot(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """The trees with (g, node) of ``roots`` as roots: parents along the way to the old root turn round."""
    spans = intervals(tree)
    wanted = spans.join(roots.select("g", "node"), ["g", "node"], "left_semi").select("g", F.col("first").alias("at"))
    way = spans.join(wanted, "g").where("at BETWEEN first AND last").select("g", "node")
    turned = tree.join(way, ["g", "node"], "left_semi").where("parent IS NOT NULL").select("g", F.col("parent").alias("node"), F.col("node").alias("new"))
    flagged = tree.join(way.withColumn("on", F.lit(True)), ["g", "node"], "left").join(turned, ["g", "node"], "left")
    return flagged.select("g", "node", F.when(F.col("on"), F.col("new")).otherwise(F.col("parent")).alias("parent"), "bag", "cover")


def reroot_covering(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rerooted at the smallest node whose bag has all of ``wanted`` (g, vertices)."""
    fits = tree.join(wanted, "g").where(F.size(F.array_except("vertices", "bag")) == 0).groupBy("g").agg(F.min("node").alias("node"))
    return reroot(tree, fits)


def remove_vertices(tree: DataFrame, gone: DataFrame) -> DataFrame:
    """Bags without (g, v); covers keep their edges."""
    lists = gone.groupBy("g").agg(F.collect_set("v").alias("gone"))
    return tree.join(lists, "g", "left").select("g", "node", "parent", F.array_except("bag", F.coalesce("gone", F.expr("cast(array() as array<bigint>)"))).alias("bag"), "cover")


def prune(tree: DataFrame) -> DataFrame:
    """Contract nodes whose bag is inside their parent's, until there are none; children move up."""
    while True:
        up = tree.select("g", F.col("node").alias("parent"), F.col("bag").alias("above"))
        gone = cut(tree.join(up, ["g", "parent"]).where(F.size(F.array_except("bag", "above")) == 0).select("g", F.col("node").alias("x"), F.col("parent").alias("to")), "gone")
        if not gone.limit(1).count():
            return tree
        # Nodes hang from the nearest kept ancestor: only contract those whose parent stays in this round.
        now = gone.join(gone.select("g", F.col("x").alias("to")), ["g", "to"], "left_anti")
        left = tree.join(now, (tree["g"] == now["g"]) & (tree["node"] == now["x"]), "left_anti")
        moved = left.join(now.select("g", F.col("x").alias("parent"), "to"), ["g", "parent"], "left")
        tree = cut(moved.select("g", "node", F.coalesce("to", "parent").alias("parent"), "bag", "cover"), "pruned")


def restore_types_in_bags(tree: DataFrame, members: DataFrame) -> DataFrame:
    """Bags with every vertex that a representative in them stands for. Trees of small graphs get them as rows (``packed``)."""
    frames = {"tree": tree.select("g", "node", "parent", "bag", "cover"), "members": members.select("g", "rep", "v")}
    fields = f"node {tree.schema['node'].dataType.simpleString()}, parent {tree.schema['parent'].dataType.simpleString()}, bag array<bigint>, cover array<bigint>"
    return packed.together(frames, small_trees.restored_rows, fields, _restore_by_joins)


def _restore_by_joins(tree: DataFrame, members: DataFrame) -> DataFrame:
    full = bag_rows(tree).select("g", "node", F.col("v").alias("rep")).join(members, ["g", "rep"]).groupBy("g", "node").agg(F.array_sort(F.collect_set("v")).alias("full"))
    return tree.join(full, ["g", "node"], "left").select("g", "node", "parent", F.coalesce("full", "bag").alias("bag"), "cover")


def edges_used(tree: DataFrame, inc: DataFrame) -> DataFrame:
    """(g, e, used): whether some node has the edge in its cover and all its vertices in its bag."""
    lists = inc.groupBy("g", "e").agg(F.collect_set("v").alias("vertices"))
    named = tree.select("g", "bag", F.explode("cover").alias("e"))
    held = lists.join(named, ["g", "e"]).where(F.size(F.array_except("vertices", "bag")) == 0).select("g", "e").distinct()
    return lists.select("g", "e").join(held.withColumn("used", F.lit(True)), ["g", "e"], "left").select("g", "e", F.coalesce("used", F.lit(False)).alias("used"))


def restore_subedges(parts: DataFrame, inc: DataFrame) -> DataFrame:
    """(g, node, e): for a cover by vertices only (g, node, vertices) the first edge with all of them; nodes without such an edge have no row."""
    size = parts.select("g", "node", F.size("vertices").alias("n"), F.explode_outer("vertices").alias("v"))
    hit = size.where("v IS NOT NULL").join(inc, ["g", "v"]).groupBy("g", "node", "n", "e").agg(F.count("*").alias("m")).where("m = n")
    first = inc.groupBy("g").agg(F.min("e").alias("e"))
    empty = size.where("v IS NULL").join(first, "g").select("g", "node", "e")
    return hit.groupBy("g", "node").agg(F.min("e").alias("e")).union(empty)
