"""Distances in the primal graph (vertices are adjacent if an edge has both)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.operators import packed
from hyperloom.storage import cut


def primal_distances(inc: DataFrame, rounds: int = 64) -> DataFrame:
    """(g, a, b, dist) of connected vertices a != b. Small graphs are searched as rows (``packed``), others by breadth-first rounds of joins from all vertices at once."""
    return packed.over_graphs(inc, packed.distance_rows, "a long, b long, dist int", lambda rows: _distances_by_joins(rows, rounds))


def _distances_by_joins(inc: DataFrame, rounds: int) -> DataFrame:
    step = inc.select("g", "e", F.col("v").alias("a")).join(inc.select("g", "e", F.col("v").alias("b")), ["g", "e"]).where("a != b").select("g", "a", "b").distinct()
    step = cut(step, "adjacent")
    known = cut(step.withColumn("dist", F.lit(1)), "distances")
    front = known
    for k in range(2, rounds):
        further = front.select("g", "a", F.col("b").alias("m")).join(step.select("g", F.col("a").alias("m"), "b"), ["g", "m"]).where("a != b").select("g", "a", "b").distinct()
        front = cut(further.join(known, ["g", "a", "b"], "left_anti").withColumn("dist", F.lit(k)), "front")
        if not front.limit(1).count():
            return known
        known = cut(known.union(front), "distances")
    raise RuntimeError(f"distances beyond {rounds} steps")


def primal_steps(inc: DataFrame) -> DataFrame:
    """(g, a, b, sole): adjacent vertices both ways, and the edge that has both if it is the only one."""
    rows = inc.select("g", "e", "v").distinct()
    pairs = rows.select("g", "e", F.col("v").alias("a")).join(rows.select("g", "e", F.col("v").alias("b")), ["g", "e"]).where("a != b")
    return pairs.groupBy("g", "a", "b").agg(F.when(F.count("*") == 1, F.min("e")).alias("sole"))


def needed_edges(steps: DataFrame, dist: DataFrame) -> DataFrame:
    """(g, e, a, b): the edges without which the distance of a and b is not kept, since every shortest path has a step that only e makes.

    A pair is supported by the vertices before b on its shortest paths. An edge takes a support away if the last step is only its own, or if the way to that vertex needs it; pairs whose supports
    are all taken need the edge. So this goes by rising distance, and a pair needs no more edges than its distance.
    """
    every = dist.agg(F.max("dist")).first()[0] or 0
    needs = cut(dist.where("dist = 1").join(steps.where("sole IS NOT NULL"), ["g", "a", "b"]).select("g", F.col("sole").alias("e"), "a", "b"), "needed")
    out = needs
    for d in range(2, every + 1):
        before = dist.where(F.col("dist") == d - 1).select("g", "a", F.col("b").alias("u"))
        ways = before.join(steps.select("g", F.col("a").alias("u"), "b", "sole"), ["g", "u"]).join(dist.where(F.col("dist") == d).select("g", "a", "b"), ["g", "a", "b"])
        ways = cut(ways.select("g", "a", "b", "u", "sole"), "supports")
        taken = ways.where("sole IS NOT NULL").select("g", F.col("sole").alias("e"), "a", "b", "u").union(ways.join(needs.withColumnRenamed("b", "u"), ["g", "a", "u"]).select("g", "e", "a", "b", "u")).distinct()
        full = ways.groupBy("g", "a", "b").agg(F.count("*").alias("n"))
        needs = cut(taken.groupBy("g", "e", "a", "b").agg(F.count("*").alias("m")).join(full, ["g", "a", "b"]).where("m = n").select("g", "e", "a", "b"), "needed")
        out = out.union(needs)
    return cut(out, "needed")


def distances_without(steps: DataFrame, dist: DataFrame, needs: DataFrame) -> DataFrame:
    """(g, e, a, b, new): distances of the pairs in ``needs`` without edge e, null for pairs that come apart; other pairs keep theirs.

    The last vertex before b either keeps its distance from a, which gives a first value, or is a pair of ``needs`` itself; values are lowered along those until none changes.
    """
    around = cut(needs.join(steps.select("g", "b", F.col("a").alias("u"), "sole"), ["g", "b"]).where("u != a AND (sole IS NULL OR sole != e)").select("g", "e", "a", "b", "u"), "around")
    kept = around.join(needs.select("g", "e", "a", F.col("b").alias("u")), ["g", "e", "a", "u"], "left_anti").join(dist.select("g", "a", F.col("b").alias("u"), "dist"), ["g", "a", "u"])
    first = kept.groupBy("g", "e", "a", "b").agg((F.min("dist") + 1).alias("new"))
    inner = cut(around.join(needs.select("g", "e", "a", F.col("b").alias("u")), ["g", "e", "a", "u"], "left_semi"), "inner")
    values = cut(needs.join(first, ["g", "e", "a", "b"], "left"), "values")
    changed = values.where("new IS NOT NULL")
    while not changed.isEmpty():
        offers = inner.join(changed.select("g", "e", "a", F.col("b").alias("u"), "new"), ["g", "e", "a", "u"]).groupBy("g", "e", "a", "b").agg((F.min("new") + 1).alias("offer"))
        told = cut(values.join(offers, ["g", "e", "a", "b"], "left").withColumn("lower", F.coalesce(F.col("offer") < F.col("new"), F.col("offer").isNotNull())), "values")
        changed = told.where("lower").select("g", "e", "a", "b", F.col("offer").alias("new"))
        values = told.select("g", "e", "a", "b", F.when(F.col("lower"), F.col("offer")).otherwise(F.col("new")).alias("new"))
    return values


def distance_change(inc: DataFrame) -> DataFrame:
    """(g, e, stretched, lost): by removing edge e, how much distances grow in sum, and how many pairs come apart. Small graphs are searched as rows (``packed``), others by joins."""
    return _changes(inc).drop("rank")


def max_separator_order(inc: DataFrame) -> DataFrame:
    """(g, e, rank): edges whose removal disconnects most pairs, then stretches distances most."""
    return _changes(inc).select("g", "e", "rank")


def _changes(inc: DataFrame) -> DataFrame:
    """(g, e, stretched, lost, rank)."""
    return packed.over_graphs(inc, packed.change_rows, "e long, stretched long, lost long, rank int", _changes_by_joins, min(packed.MOST, packed.MOST_TRIED))


def _changes_by_joins(inc: DataFrame) -> DataFrame:
    """No graph is copied: only the pairs that need an edge (``needed_edges``) are searched again without it."""
    steps, dist = cut(primal_steps(inc), "steps"), cut(primal_distances(inc), "distances")
    after = distances_without(steps, dist, needed_edges(steps, dist)).join(dist, ["g", "a", "b"])
    sums = after.groupBy("g", "e").agg(F.sum(F.coalesce(F.col("new") - F.col("dist"), F.lit(0))).alias("stretched"), F.sum(F.when(F.col("new").isNull(), 1).otherwise(0)).alias("lost"))
    every = inc.select("g", "e").distinct().join(sums, ["g", "e"], "left")
    # Graphs without a pair of adjacent vertices have no distances to change and no rows.
    changes = every.join(dist.select("g").distinct(), "g", "left_semi").select("g", "e", F.coalesce("stretched", F.lit(0)).alias("stretched"), F.coalesce("lost", F.lit(0)).alias("lost"))
    order = Window.partitionBy("g").orderBy(F.desc("lost"), F.desc("stretched"), "e")
    return changes.withColumn("rank", F.row_number().over(order))
