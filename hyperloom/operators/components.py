"""Components without a separator's vertices, and balanced separators.

``seps`` are rows (g, s, v): the vertices of separator s of graph g, so that many separators of a graph are tested in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.functions.sets import balance_limit, powerset
from hyperloom.operators import packed
from hyperloom.operators.incidence import lowest_edges, sizes
from hyperloom.storage import cut


def components(inc: DataFrame, seps: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """(g, s, e, comp) for edges with a vertex outside the separator; comp is the smallest edge of the component.

    ``graphs`` (g, s) lists the separators, needed where one may be empty. Each round every edge takes the smallest label
    among its vertices' edges, then the label of its label.
    """
    names = (graphs if graphs is not None else seps.select("g", "s")).distinct()
    rest = cut(inc.join(names, "g").join(seps, ["g", "s", "v"], "left_anti").select("g", "s", "e", "v"), "rest")
    labels = cut(rest.select("g", "s", "e").distinct().withColumn("comp", F.col("e")), "labels")
    while True:
        around = rest.join(labels, ["g", "s", "e"]).groupBy("g", "s", "v").agg(F.min("comp").alias("comp"))
        lower = rest.join(around, ["g", "s", "v"]).groupBy("g", "s", "e").agg(F.min("comp").alias("low"))
        jump = lower.select("g", "s", F.col("e").alias("low"), F.col("low").alias("lower"))
        new = lower.join(jump, ["g", "s", "low"], "left").join(labels, ["g", "s", "e"]).select(
            "g", "s", "e", F.least("low", F.coalesce("lower", "low")).alias("comp"), (F.col("comp") != F.least("low", F.coalesce("lower", "low"))).alias("changed")
        )
        new = cut(new, "labels")
        if not new.where("changed").limit(1).count():
            return new.select("g", "s", "e", "comp")
        labels = new.drop("changed")


def edge_combinations(inc: DataFrame, most: int = 2, least: int = 1) -> DataFrame:
    """(g, s, e): every set of ``least`` to ``most`` edges of a graph; s is its ids joined by commas. Self-joins inside a graph."""
    edges = inc.select("g", "e").distinct()
    level = edges.select("g", F.array("e").alias("combo"))
    out = [level] if least <= 1 else []
    for k in range(2, most + 1):
        level = level.join(edges, "g").where(F.col("e") > F.element_at("combo", -1)).select("g", F.array_append("combo", F.col("e")).alias("combo"))
        if k >= least:
            out.append(level)
    joined = out[0]
    for frame in out[1:]:
        joined = joined.union(frame)
    return joined.select("g", F.array_join("combo", ",").alias("s"), F.explode("combo").alias("e"))


def separators(inc: DataFrame, combos: DataFrame) -> DataFrame:
    """(g, s, v) of edge combinations (g, s, e)."""
    return combos.join(inc, ["g", "e"]).select("g", "s", "v").distinct()


def separator_sizes(inc: DataFrame, most: int = 2) -> DataFrame:
    """(g, s, vertices): how many vertices each set of at most ``most`` edges has; the sets of a small graph are made in its row, so that no candidate is exchanged."""
    by_joins = lambda rows: separators(rows, edge_combinations(rows, most)).groupBy("g", "s").agg(F.count("*").alias("vertices"))
    return packed.over_graphs(inc, packed.union_rows(most), "s string, vertices long", by_joins, min(packed.MOST, packed.MOST_TRIED))


def balanced(inc: DataFrame, combos: DataFrame, factor: int = 2) -> DataFrame:
    """(g, s, size, largest) of combinations that leave no component above floor(edges * (factor - 1) / factor)."""
    names = cut(combos.groupBy("g", "s").agg(F.count("*").alias("size")), "names")
    found = components(inc, separators(inc, combos), names.select("g", "s"))
    largest = found.groupBy("g", "s", "comp").count().groupBy("g", "s").agg(F.max("count").alias("largest"))
    total = sizes(inc).groupBy("g").agg(F.count("*").alias("edges"))
    scored = names.join(largest, ["g", "s"], "left").join(total, "g").withColumn("largest", F.coalesce("largest", F.lit(0)))
    return scored.where(F.col("largest") <= F.expr(f"edges * {factor - 1} DIV {factor}")).select("g", "s", "size", "largest")


def balanced_sets(inc: DataFrame, most: int = 2, factor: int = 2) -> DataFrame:
    """``balanced`` of all sets of at most ``most`` edges; a small graph is one row, and its sets are made and tested without an exchange."""
    by_joins = lambda rows: balanced(rows, edge_combinations(rows, most), factor)
    return packed.over_graphs(inc, packed.balanced_rows(most, factor), "s string, size long, largest long", by_joins, min(packed.MOST, packed.MOST_TRIED))


def without_lowest(inc: DataFrame, k: int = 2) -> DataFrame:
    """Components of each graph without the vertices of its k lowest edges."""
    seps = inc.join(lowest_edges(inc, k), ["g", "e"], "left_semi").select("g", F.lit("low").alias("s"), "v").distinct()
    return components(inc, seps, inc.select("g", F.lit("low").alias("s")))


def whole(inc: DataFrame) -> DataFrame:
    """Components with the empty separator."""
    names = inc.select("g", F.lit("").alias("s")).distinct()
    return components(inc, names.select("g", "s", F.lit(None).cast("long").alias("v")).limit(0), names)


def cover_levels(inc: DataFrame, conn: DataFrame, most: int = 2, beyond: bool = True, component: DataFrame | None = None) -> list[DataFrame]:
    """One frame (g, chosen, left, pos, inner) for each number of edges from 1 to ``most``: chosen edges of those that touch ``conn`` (g, v), in order of falling weight (vertices of conn in the edge; then by id),
    and the vertices of conn that they leave.

    With r edges still to choose, the next one at position p, no choice covers more than the sum of the r weights from p on. These windowed sums fall along the positions, so for each number of
    vertices left there is a last position to go on with; the join makes rows up to there and none beyond. Without ``beyond`` a set that covers is not extended. With ``component`` (g, v)
    an edge with a vertex of it outside conn has to be chosen (``inner``).
    """
    conn = conn.select("g", "v").distinct()
    rows = inc.select("g", "e", "v").distinct()
    hits = rows.join(conn, ["g", "v"], "left_semi").groupBy("g", "e").agg(F.array_sort(F.collect_list("v")).alias("hits"))
    if component is None:
        hits = hits.withColumn("in", F.lit(True))
    else:
        reached = rows.join(component.select("g", "v").distinct(), ["g", "v"], "left_semi").join(conn, ["g", "v"], "left_anti").select("g", "e").distinct()
        hits = hits.join(reached.withColumn("in", F.lit(True)), ["g", "e"], "left").withColumn("in", F.coalesce("in", F.lit(False)))
    order = Window.partitionBy("g").orderBy(F.desc(F.size("hits")), "e")
    edges = cut(hits.withColumn("at", F.row_number().over(order)), "cover-edges")
    wanted = conn.groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("left"))
    level = wanted.select("g", F.expr("CAST(array() AS array<bigint>)").alias("chosen"), "left", F.lit(0).alias("pos"), F.lit(component is None).alias("inner"))
    out = []
    for r in range(most, 0, -1):
        sums = edges.select("g", "at", F.sum(F.size("hits")).over(Window.partitionBy("g").orderBy("at").rowsBetween(0, r - 1)).alias("bound"))
        steps = sums.groupBy("g", "bound").agg(F.max("at").alias("until"))
        lower = F.coalesce(F.lag("bound").over(Window.partitionBy("g").orderBy("bound")) + 1, F.lit(0))
        limits = steps.withColumn("lower", lower).select("g", "until", F.explode(F.sequence("lower", "bound")).alias("n"))
        going = (level if beyond else level.where("size(left) > 0")).withColumn("n", F.size("left").cast("long"))
        reach = going.join(limits, ["g", "n"]).where("pos < until").withColumn("at", F.explode(F.expr("sequence(pos + 1, until)")))
        joined = reach.join(edges, ["g", "at"])
        if r == 1:
            joined = joined.where(F.col("inner") | F.col("in"))
        level = cut(joined.select("g", F.array_append("chosen", F.col("e")).alias("chosen"), F.array_except("left", "hits").alias("left"), F.col("at").alias("pos"), (F.col("inner") | F.col("in")).alias("inner")), "covers")
        out.append(level)
    return out


def covers(inc: DataFrame, conn: DataFrame, most: int = 2, beyond: bool = True, component: DataFrame | None = None) -> DataFrame:
    """(g, s, size): sets of at most ``most`` edges touching ``conn`` (g, v) that cover all of it, each edge touching it; see ``cover_levels``."""
    levels = cover_levels(inc, conn, most, beyond, component)
    every = levels[0]
    for frame in levels[1:]:
        every = every.union(frame)
    return every.where("size(left) = 0 AND inner").select("g", F.array_join(F.array_sort("chosen"), ",").alias("s"), F.size("chosen").cast("long").alias("size"))


def by_cost(found: DataFrame, costs: DataFrame) -> DataFrame:
    """(g, s, cost, rank) of separators, cheapest first; a separator without a cost is an error."""
    joined = found.join(costs, ["g", "s"], "left").withColumn("cost", F.when(F.col("cost").isNull(), F.raise_error(F.concat(F.lit("no cost for separator "), "s")).cast("double")).otherwise(F.col("cost")))
    return joined.select("g", "s", "cost", F.row_number().over(Window.partitionBy("g").orderBy("cost", "s")).alias("rank"))


def sets_within(edges: DataFrame, bands: DataFrame, most: int) -> DataFrame:
    """(g, chosen, cost): sets of at most ``most`` of ``edges`` (g, e, cost, at: place by cost) whose costs sum to more than ``low`` and at most ``high`` of ``bands`` (g, low, high).

    Edges are added in order of cost, so for a set so far there is a last place whose edge still fits; the places up to it are made by a sequence, and none beyond.
    """
    level = bands.select("g", "low", "high", F.expr("CAST(array() AS array<bigint>)").alias("chosen"), F.lit(0).alias("pos"), F.lit(0.0).alias("sum"))
    out = []
    for _ in range(most):
        # The room is a bit wider than what is left, so that no rounding hides a set; the exact comparison follows.
        room = level.withColumn("room", (F.col("high") - F.col("sum")) + F.col("high") * 1e-9)
        marks = edges.select("g", F.col("cost").alias("room"), "at", F.lit(None).cast("array<bigint>").alias("chosen")).union(room.select("g", "room", F.lit(None).cast("int"), "chosen"))
        until = F.max("at").over(Window.partitionBy("g").orderBy("room", F.asc_nulls_last("at")).rowsBetween(Window.unboundedPreceding, 0))
        reach = marks.withColumn("until", until).where("chosen IS NOT NULL").select("g", "chosen", "until").join(room, ["g", "chosen"]).where("pos < until")
        joined = reach.withColumn("at", F.explode(F.expr("sequence(pos + 1, until)"))).join(edges, ["g", "at"])
        level = joined.select("g", "low", "high", F.array_append("chosen", F.col("e")).alias("chosen"), F.col("at").alias("pos"), (F.col("sum") + F.col("cost")).alias("sum")).where("sum <= high")
        level = cut(level, "sets-within")
        out.append(level.where("sum > low").select("g", "chosen", F.col("sum").alias("cost")))
    every = out[0]
    for frame in out[1:]:
        every = every.union(frame)
    return every


def cheapest_balanced(inc: DataFrame, costs: DataFrame, most: int = 2, growth: float = 4.0) -> DataFrame:
    """(g, s, cost, tested): the balanced separator of at most ``most`` edges whose edges' costs (g, e, cost) have the smallest sum (then by s), null if there is none, and how many candidates were tested.

    Candidates are made and tested in bands of rising cost, the first up to the smallest cost above 0 and each as far as ``growth`` times the one before; a graph stops at the band with its first hit, since all
    sets beyond cost more. An edge without a cost, or with one below 0, is an error. Small graphs are searched as rows (``packed``), others in bands by joins.
    """
    known = inc.select("g", "e").distinct().join(costs, ["g", "e"], "left")
    checked = F.when(F.col("cost").isNull() | (F.col("cost") < 0), F.raise_error(F.concat(F.lit("no cost from 0 on for edge "), F.col("e").cast("string"))).cast("double")).otherwise(F.col("cost").cast("double"))
    priced = inc.join(known.select("g", "e", checked.alias("cost")), ["g", "e"]).select("g", "e", "v", "cost")
    by_bands = lambda rows: _cheapest_by_bands(rows, most, growth)
    return packed.over_graphs(priced, packed.cheapest_rows(most, growth), "s string, cost double, tested long", by_bands, min(packed.MOST, packed.MOST_TRIED))


def _cheapest_by_bands(inc: DataFrame, most: int, growth: float) -> DataFrame:
    edges = inc.select("g", "e", "cost").distinct()
    edges = cut(edges.withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy("cost", "e"))), "edge-costs")
    ends = edges.groupBy("g").agg(F.coalesce(F.min(F.when(F.col("cost") > 0, F.col("cost"))), F.lit(0.0)).alias("high"), (F.max("cost") * most).alias("end"))
    bands = cut(ends.select("g", F.lit(-1.0).alias("low"), "high", "end"), "bands")
    hits, tested = None, None
    while not bands.isEmpty():
        found = cut(sets_within(edges, bands, most).select("g", F.array_sort("chosen").alias("chosen"), "cost").withColumn("s", F.array_join("chosen", ",")), "candidates")
        good = balanced(inc, found.select("g", "s", F.explode("chosen").alias("e"))).select("g", "s")
        best = cut(found.join(good, ["g", "s"], "left_semi").groupBy("g").agg(F.min(F.struct("cost", "s")).alias("k")).select("g", "k.s", "k.cost"), "cheapest")
        counts = cut(found.groupBy("g").agg(F.count("*").alias("n")), "tested")
        hits, tested = (best, counts) if hits is None else (hits.union(best), tested.union(counts))
        open_ = bands.join(best, "g", "left_anti").where("high < end")
        bands = cut(open_.select("g", F.col("high").alias("low"), (F.col("high") * growth).alias("high"), "end"), "bands")
    return tested.groupBy("g").agg(F.sum("n").alias("tested")).join(hits, "g", "left").select("g", "s", "cost", "tested")


def subedges(inc: DataFrame, k: int = 2) -> DataFrame:
    """(g, e, subset): the non-empty proper subsets of unions of up to ``k`` proper intersections of edge e with others, each once.

    Subsets of an edge number two to the power of its arity, so this is meant for edges of bounded arity.
    """
    meet = inc.join(inc.select("g", "v", F.col("e").alias("f")), ["g", "v"]).where("e != f").groupBy("g", "e", "f").agg(F.array_sort(F.collect_set("v")).alias("s"))
    base = meet.join(sizes(inc), ["g", "e"]).where(F.size("s") < F.col("arity")).select("g", "e", "s").distinct()
    unions = base
    for _ in range(k - 1):
        unions = unions.join(base.select("g", "e", F.col("s").alias("t")), ["g", "e"]).select("g", "e", F.array_sort(F.array_union("s", "t")).alias("s")).distinct()
    found = unions.select("g", "e", F.explode(powerset(F.col("s"))).alias("subset")).where(F.size("subset") > 0).distinct()
    return found.join(sizes(inc), ["g", "e"]).where(F.size("subset") < F.col("arity")).select("g", "e", "subset")


def subedge_closure(inc: DataFrame, k: int = 2) -> DataFrame:
    """(g, e, subset): all edges and subedges, each vertex set once, with the smallest edge that has it."""
    whole = inc.groupBy("g", "e").agg(F.array_sort(F.collect_set("v")).alias("subset"))
    return subedges(inc, k).union(whole).groupBy("g", "subset").agg(F.min("e").alias("e")).select("g", "e", "subset")


def components_with_specials(inc: DataFrame, specials: DataFrame, seps: DataFrame) -> DataFrame:
    """``components`` where special edges (g, e, v), with ids unlike the edges', join components too; one inside the separator is a component of its own."""
    names = seps.select("g", "s").distinct()
    found = components(inc.select("g", "e", "v").union(specials.select("g", "e", "v")), seps)
    alone = specials.select("g", "e").distinct().join(names, "g").join(found, ["g", "s", "e"], "left_anti")
    return found.union(alone.select("g", "s", "e", F.col("e").alias("comp")))


def balance_with_specials(inc: DataFrame, specials: DataFrame, seps: DataFrame, factor: int = 2) -> DataFrame:
    """(g, s, small_parts, balanced): no component above the limit of edges and special edges together, and, for ``balanced``, no special edge with the separator's vertices."""
    parts = components_with_specials(inc, specials, seps).groupBy("g", "s", "comp").count().groupBy("g", "s").agg(F.max("count").alias("largest"))
    total = inc.select("g", "e").distinct().union(specials.select("g", "e").distinct()).groupBy("g").agg(F.count("*").alias("edges"))
    own = seps.groupBy("g", "s").agg(F.array_sort(F.collect_set("v")).alias("vertices"))
    sets = specials.groupBy("g", "e").agg(F.array_sort(F.collect_set("v")).alias("vertices")).select("g", "vertices").distinct().withColumn("same", F.lit(True))
    joined = own.join(total, "g").join(parts, ["g", "s"], "left").join(sets, ["g", "vertices"], "left")
    small = F.coalesce("largest", F.lit(0)) <= balance_limit("edges", factor)
    return joined.select("g", "s", small.alias("small_parts"), (small & F.col("same").isNull()).alias("balanced"))
