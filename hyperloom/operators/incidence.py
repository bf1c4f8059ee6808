"""Hypergraphs as incidence rows (g, e, v): graph, edge, vertex.

Every operator keys on the graph, so many graphs are handled at once and joins never leave a graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Line items of a task, at most about that many.
TASK_ROWS = 1 << 19

CORPORA = {"hm": "1 + l_suppkey % 10", "hs": "l_suppkey", "hp": "l_partkey"}


def corpus(spark: SparkSession, sf_dir: str, kind: str = "hm") -> DataFrame:
    """A hypergraph for each customer: orders are edges, and vertices come from their line items."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.expr(CORPORA[kind]).cast("long").alias("v"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").distinct()
    # Dealt by order in a number of parts that grows with the rows: distinct rows and the join need no other exchange, and adaptive execution does not join the parts to few large tasks.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), items.count() // TASK_ROWS)
    items = items.repartition(tasks, "l_orderkey").distinct()
    joined = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    return joined.select(F.col("o_custkey").cast("long").alias("g"), F.col("l_orderkey").cast("long").alias("e"), "v")


def edge_lists(inc: DataFrame) -> DataFrame:
    """(g, e, vertices): sorted vertices of each edge."""
    return inc.groupBy("g", "e").agg(F.array_sort(F.collect_set("v")).alias("vertices"))


def sizes(inc: DataFrame) -> DataFrame:
    return inc.groupBy("g", "e").agg(F.count_distinct("v").alias("arity"))


def vertex_degree(inc: DataFrame) -> DataFrame:
    return inc.groupBy("g", "v").agg(F.count_distinct("e").alias("degree"))


def overlaps(inc: DataFrame) -> DataFrame:
    """(g, e1, e2, shared) for edges e1 != e2 with common vertices: an equi-join on the vertex."""
    a, b = inc.select("g", "v", F.col("e").alias("e1")).distinct(), inc.select("g", "v", F.col("e").alias("e2")).distinct()
    return a.join(b, ["g", "v"]).where("e1 != e2").groupBy("g", "e1", "e2").agg(F.count("*").alias("shared"))


def pairwise_intersections(inc: DataFrame) -> DataFrame:
    return overlaps(inc).where("e1 < e2")


def edge_degree(inc: DataFrame) -> DataFrame:
    """Edges that share a vertex, the edge itself included."""
    met = overlaps(inc).groupBy("g", F.col("e1").alias("e")).agg(F.count("*").alias("n"))
    return inc.select("g", "e").distinct().join(met, ["g", "e"], "left").select("g", "e", (F.coalesce("n", F.lit(0)) + 1).alias("degree"))


def edge_vertex_degree(inc: DataFrame) -> DataFrame:
    """Sum of the vertices' degrees less the arity."""
    return inc.distinct().join(vertex_degree(inc), ["g", "v"]).groupBy("g", "e").agg((F.sum("degree") - F.count("*")).alias("weight"))


def bip(inc: DataFrame) -> DataFrame:
    """Largest intersection of two edges of each graph; 0 if none meet."""
    best = pairwise_intersections(inc).groupBy("g").agg(F.max("shared").alias("m"))
    return inc.select("g").distinct().join(best, "g", "left").select("g", F.coalesce("m", F.lit(0)).alias("bip"))


def statistics(inc: DataFrame) -> DataFrame:
    edges = sizes(inc).groupBy("g").agg(F.avg("arity").alias("avg_arity"), F.count("*").alias("edges"), F.max("arity").alias("max_arity"), F.sum("arity").alias("sum_arity"))
    vertices = vertex_degree(inc).groupBy("g").agg(F.count("*").alias("vertices"), F.max("degree").alias("max_degree"))
    return edges.join(vertices, "g")


def lowest_edges(inc: DataFrame, k: int) -> DataFrame:
    """(g, e): the k edges of each graph with the smallest ids."""
    return positions(inc).where(F.col("pos") <= k).select("g", "e")


def positions(inc: DataFrame) -> DataFrame:
    order = Window.partitionBy("g").orderBy("e")
    return inc.select("g", "e").distinct().withColumn("pos", F.row_number().over(order))


def separator_vertices(inc: DataFrame, edges: DataFrame) -> DataFrame:
    return inc.join(edges, ["g", "e"], "left_semi").select("g", "v").distinct()


def filter_intersecting(inc: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with a vertex among (g, v), unchanged."""
    hit = inc.join(vertices, ["g", "v"], "left_semi").select("g", "e").distinct()
    return inc.join(hit, ["g", "e"], "left_semi")


def filter_contained(inc: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with all vertices among (g, v)."""
    outside = inc.join(vertices, ["g", "v"], "left_anti").select("g", "e").distinct()
    return inc.join(outside, ["g", "e"], "left_anti")


def cut_edges(inc: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges cut down to (g, v); those left empty vanish."""
    return inc.join(vertices, ["g", "v"], "left_semi")


def except_edges(inc: DataFrame, edges: DataFrame) -> DataFrame:
    """Without edges of these names."""
    return inc.join(edges, ["g", "e"], "left_anti")


def except_content(inc: DataFrame, other: DataFrame) -> DataFrame:
    """Without every edge whose vertex set is that of an edge of ``other``."""
    gone = edge_lists(inc).join(edge_lists(other).select("g", "vertices"), ["g", "vertices"], "left_semi").select("g", "e")
    return inc.join(gone, ["g", "e"], "left_anti")


def distinct_edges(inc: DataFrame) -> DataFrame:
    """(g, e, vertices) with one edge, the smallest id, for each vertex set."""
    return edge_lists(inc).groupBy("g", "vertices").agg(F.min("e").alias("e")).select("g", "e", "vertices")


def same_graph(a: DataFrame, b: DataFrame) -> DataFrame:
    """(g, equal): graphs of both with equal edges."""
    left = edge_lists(a).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("e", "vertices"))).alias("x"))
    right = edge_lists(b).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("e", "vertices"))).alias("y"))
    return left.join(right, "g", "full").select("g", F.expr("x <=> y").alias("equal"))


def make_distinct(inc: DataFrame) -> DataFrame:
    """One fresh vertex in each edge, so that no edge is in another."""
    most = inc.groupBy("g").agg(F.greatest(F.max("v"), F.lit(0)).alias("top"))
    fresh = positions(inc).join(most, "g").select("g", "e", (F.col("top") + F.col("pos")).cast("long").alias("v"))
    return inc.select("g", "e", "v").union(fresh)


def edge_order(inc: DataFrame, heuristic: str) -> DataFrame:
    """(g, e, rank) by descending 'vertex_degree' or 'edge_degree' weight, ties by id."""
    weights = edge_vertex_degree(inc) if heuristic == "vertex_degree" else edge_degree(inc).withColumnRenamed("degree", "weight")
    return weights.select("g", "e", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("weight"), "e")).alias("rank"))


def order_by_arity(inc: DataFrame) -> DataFrame:
    """(g, e, rank): by arity, then by the sorted vertices, then by id."""
    order = Window.partitionBy("g").orderBy(F.size("vertices"), "vertices", "e")
    return edge_lists(inc).select("g", "e", F.row_number().over(order).alias("rank"))
