"""Queries over lists, trees, text formats and subedges of the graphs in ``corpus_queries``, and the SQL they equal.

Trees here are made from a graph without a search: a node for each edge, in a line by edge order. Most are no decompositions, so the checks have
both answers; the ``broken`` ones also miss vertices, have foreign ones, or name edges that are not there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.functions import sets
from hyperloom.operators import components as comp
from hyperloom.operators import incidence as inc
from hyperloom.operators import hinges, reductions, repair, search_orders, trees
from hyperloom.plans.corpus_queries import _HINGE, _HM, _HP, _LOW, _POS, _REDUCED, _TYPES, ORACLES, QUERIES, _gyo_sql, _low, query  # noqa: F401
from hyperloom.sources import text_formats
from hyperloom.storage import cut

_TEXT = lambda c: F.array_join(c, ",")


# --- lists ---

_LISTS = (
    "ol AS (SELECT o_custkey::BIGINT AS g, o_orderkey::BIGINT AS e, list((1 + l_suppkey % 10)::BIGINT ORDER BY l_linenumber, l_suppkey % 10) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),"
    " pr AS (SELECT g, e, a, lead(a) OVER (PARTITION BY g ORDER BY e) AS b FROM ol)"
)


def _raw_pairs(spark, sf_dir) -> DataFrame:
    """(g, e, a, b): vertices of an order in line order (ties by vertex), with repeats, and those of the customer's next order."""
    from pyspark.sql import Window

    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "CAST(1 + l_suppkey % 10 AS BIGINT) AS v")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    lists = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "v")))["v"].alias("a")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = lists.select(F.col("o_custkey").cast("long").alias("g"), F.col("l_orderkey").cast("long").alias("e"), "a")
    return pairs.withColumn("b", F.lead("a").over(Window.partitionBy("g").orderBy("e"))).where("b IS NOT NULL")


@query(
    f"{_LISTS} SELECT g, e, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ',') AS both, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS only_a,"
    " list_has_all(b, a) AS subset, list_has_any(a, b) AS neighbours, list_contains(a, b[1]) AS member, array_to_string(list_sort(list_distinct(a)), ',') AS vertices,"
    " list_has_all(a, [b[1]]) AND list_has_any(a, b) AS connecting FROM pr WHERE b IS NOT NULL"
)
def list_algebra(spark, sf_dir):
    return _raw_pairs(spark, sf_dir).select(
        "g", "e", _TEXT(sets.intersect_keep(F.col("a"), F.col("b"))).alias("both"), _TEXT(sets.except_keep(F.col("a"), F.col("b"))).alias("only_a"), sets.is_subset(F.col("a"), F.col("b")).alias("subset"),
        sets.neighbours(F.col("a"), F.col("b")).alias("neighbours"), F.array_contains("a", F.element_at("b", 1)).alias("member"), _TEXT(sets.vertex_set(F.col("a"))).alias("vertices"),
        sets.connecting(F.col("a"), F.slice("b", 1, 1), F.col("b")).alias("connecting"),
    )


@query(
    f"{_HM}, n AS (SELECT g, count(DISTINCT e) AS n, count(DISTINCT v) AS m FROM inc GROUP BY g) SELECT g, greatest(n, m) AS larger, least(n, m) AS smaller, greatest(n - 1, 0) AS less, n * (n - 1) // 2 AS pairs,"
    " n * (n - 1) * (n - 2) // 6 AS triples, n + n * (n - 1) // 2 + n * (n - 1) * (n - 2) // 6 AS up_to_three, n // 2 AS half_limit, repeat(' ', n) AS indent FROM n"
)
def size_arithmetic(spark, sf_dir):
    n = inc.corpus(spark, sf_dir).groupBy("g").agg(F.count_distinct("e").alias("n"), F.count_distinct("v").alias("m"))
    return n.select(
        "g", F.greatest("n", "m").alias("larger"), F.least("n", "m").alias("smaller"), sets.decrease("n").alias("less"), sets.choose(F.col("n"), 2).alias("pairs"), sets.choose(F.col("n"), 3).alias("triples"),
        sum((sets.choose(F.col("n"), k) for k in (2, 3)), sets.choose(F.col("n"), 1)).alias("up_to_three"), sets.balance_limit("n").alias("half_limit"), F.repeat(F.lit(" "), F.col("n").cast("int")).alias("indent"),
    )


@query(f"{_HM}, {_POS} SELECT a.g, a.e AS e1, b.e AS e2, row_number() OVER (PARTITION BY a.g ORDER BY b.p, a.p) - 1 AS rank FROM pos a JOIN pos b ON a.g = b.g AND a.p < b.p")
def combination_ranks(spark, sf_dir):
    """Pairs of edges of a graph by their rank among all pairs, computed from the positions alone."""
    pos = inc.positions(inc.corpus(spark, sf_dir))
    pairs = pos.select("g", F.col("e").alias("e1"), F.col("pos").alias("p1")).join(pos.select("g", F.col("e").alias("e2"), F.col("pos").alias("p2")), "g").where("p1 < p2")
    return pairs.select("g", "e1", "e2", sets.combination_rank([F.col("p1"), F.col("p2")]).alias("rank"))


@query(f"{_HM}, l AS (SELECT g, e, list(v ORDER BY v) AS vs FROM inc GROUP BY g, e) SELECT g, e, row_number() OVER (PARTITION BY g ORDER BY len(vs), vs, e)::INT AS rank FROM l")
def edge_order_by_arity(spark, sf_dir):
    return inc.order_by_arity(inc.corpus(spark, sf_dir))


@query(f"{_HM}, k AS (SELECT * FROM inc WHERE NOT (e % 9 = 0 AND v > 5)), x AS (SELECT g, string_agg(e || ':' || v, ' ' ORDER BY e, v) AS t FROM inc GROUP BY g), y AS (SELECT g, string_agg(e || ':' || v, ' ' ORDER BY e, v) AS t FROM k GROUP BY g) SELECT g, x.t IS NOT DISTINCT FROM y.t AS equal FROM x FULL JOIN y USING (g)")
def same_graph(spark, sf_dir):
    h = inc.corpus(spark, sf_dir)
    return inc.same_graph(h, h.where("NOT (e % 9 = 0 AND v > 5)"))


@query(f"{_HM}, {_POS}, l AS (SELECT g, e, string_agg(v, ',' ORDER BY v) AS vs FROM inc GROUP BY g, e) SELECT inc.* FROM inc JOIN l USING (g, e) WHERE NOT EXISTS (SELECT 1 FROM l o JOIN pos USING (g, e) WHERE p <= 2 AND o.g = l.g AND o.vs = l.vs)")
def except_content(spark, sf_dir):
    h = inc.corpus(spark, sf_dir)
    return inc.except_content(h, h.join(inc.lowest_edges(h, 2), ["g", "e"], "left_semi"))


@query(f"{_HM}, {_POS} SELECT * FROM inc UNION ALL SELECT g, e, (SELECT max(v) FROM inc i WHERE i.g = pos.g) + p FROM pos")
def make_distinct(spark, sf_dir):
    return inc.make_distinct(inc.corpus(spark, sf_dir))


@query(
    f"{_HM}, {_TYPES}, "
    + _gyo_sql("inc AS (SELECT inc.* FROM inc SEMI JOIN (SELECT g, rep AS v FROM mem) r USING (g, v))", 7)
    + ", s AS (SELECT g, e, count(*) AS arity FROM i7 GROUP BY g, e), a AS (SELECT g, avg(arity) AS avg_arity, count(*) AS edges, max(arity) AS max_arity, sum(arity)::BIGINT AS sum_arity FROM s GROUP BY g),"
    " b AS (SELECT g, count(*) AS vertices, max(degree) AS max_degree FROM (SELECT g, v, count(*) AS degree FROM i7 GROUP BY g, v) GROUP BY g) SELECT * FROM a JOIN b USING (g)"
)
def stats_reduced(spark, sf_dir):
    """Statistics of what type collapse and the acyclicity reduction leave."""
    return inc.statistics(reductions.gyo(reductions.type_collapse(inc.corpus(spark, sf_dir))[0]))


# --- trees ---

_CHAIN = f"{_POS}, ch AS (SELECT g, p AS node, CASE WHEN p > 1 THEN p - 1 END AS parent, e, list(v ORDER BY v) AS bag FROM inc JOIN pos USING (g, e) GROUP BY ALL)"
_BROKEN = (
    f"{_CHAIN}, br AS (SELECT g, node, parent, CASE WHEN g % 2 = 0 AND node % 5 = 0 THEN bag[2:] WHEN g % 3 = 0 AND node % 7 = 0 THEN list_append(bag, 99) ELSE bag END AS bag, CASE WHEN g % 11 = 0 AND node = 2 THEN -1 ELSE e END AS e FROM ch),"
    " bv AS (SELECT g, node, unnest(bag) AS v FROM br), cv AS (SELECT g, node, v FROM br JOIN inc USING (g, e))"
)


def _chain(spark, sf_dir, parent: str = "pos - 1") -> tuple[DataFrame, DataFrame]:
    h = inc.corpus(spark, sf_dir)
    nodes = inc.edge_lists(h).join(inc.positions(h), ["g", "e"])
    return h, nodes.select("g", F.col("pos").cast("int").alias("node"), F.expr(f"CASE WHEN pos > 1 THEN CAST({parent} AS INT) END").alias("parent"), F.col("vertices").alias("bag"), F.array("e").alias("cover"))


def _broken(spark, sf_dir, parent: str = "pos - 1") -> tuple[DataFrame, DataFrame]:
    h, tree = _chain(spark, sf_dir, parent)
    bag = F.expr("CASE WHEN g % 2 = 0 AND node % 5 = 0 THEN slice(bag, 2, size(bag)) WHEN g % 3 = 0 AND node % 7 = 0 THEN array_append(bag, 99L) ELSE bag END")
    return h, tree.withColumns({"bag": bag, "cover": F.expr("CASE WHEN g % 11 = 0 AND node = 2 THEN array(-1L) ELSE cover END")})


@query(
    f"{_HM}, {_BROKEN}, f1 AS (SELECT DISTINCT g FROM bv ANTI JOIN cv USING (g, node, v)), f2 AS (SELECT DISTINCT g FROM br WHERE e = -1),"
    " hold AS (SELECT DISTINCT i.g, i.e FROM (SELECT g, e, list(v) AS vs FROM inc GROUP BY g, e) i JOIN br ON br.g = i.g AND list_has_all(br.bag, i.vs)), f3 AS (SELECT DISTINCT g FROM (SELECT DISTINCT g, e FROM inc) ANTI JOIN hold USING (g, e)),"
    " f4 AS (SELECT DISTINCT g FROM (SELECT g, v FROM bv GROUP BY g, v HAVING max(node) - min(node) + 1 != count(*))),"
    " f5 AS (SELECT DISTINCT m.g FROM (SELECT * FROM cv ANTI JOIN bv USING (g, node, v)) m JOIN bv ON bv.g = m.g AND bv.v = m.v AND bv.node > m.node),"
    " t AS (SELECT g, 1 AS width, g NOT IN (FROM f1) AS bags_covered, g NOT IN (FROM f2) AS covers_known, g NOT IN (FROM f3) AS edges_in_bags, g NOT IN (FROM f4) AS connected, g NOT IN (FROM f5) AS special_condition FROM (SELECT DISTINCT g FROM br))"
    " SELECT *, bags_covered AND covers_known AND edges_in_bags AND connected AS valid FROM t"
)
def tree_checks(spark, sf_dir):
    h, tree = _broken(spark, sf_dir)
    return trees.validate(cut(tree, "tree"), h)


@query(f"{_HM}, {_BROKEN} SELECT i.g, i.e, count(br.node) > 0 AS used FROM (SELECT g, e, list(v) AS vs FROM inc GROUP BY g, e) i LEFT JOIN br ON br.g = i.g AND br.e = i.e AND list_has_all(br.bag, i.vs) GROUP BY i.g, i.e")
def edges_used(spark, sf_dir):
    h, tree = _broken(spark, sf_dir)
    return trees.edges_used(tree, h)


@query(f"{_HM}, {_CHAIN}, m AS (SELECT g, (max(node) + 1) // 2 AS r FROM ch GROUP BY g) SELECT g, node, CASE WHEN node < r THEN node + 1 WHEN node > r THEN node - 1 END AS parent FROM ch JOIN m USING (g)")
def tree_reroot(spark, sf_dir):
    _, tree = _chain(spark, sf_dir)
    tree = cut(tree, "tree")
    roots = tree.groupBy("g").agg(F.expr("CAST((max(node) + 1) DIV 2 AS INT)").alias("node"))
    return trees.reroot(tree, roots).select("g", "node", "parent")


@query(f"{_HM}, {_CHAIN}, w AS (SELECT g, arg_max(bag, node) AS vs FROM ch GROUP BY g), m AS (SELECT g, min(node) AS r FROM ch JOIN w USING (g) WHERE list_has_all(bag, vs) GROUP BY g) SELECT g, node, CASE WHEN node < r THEN node + 1 WHEN node > r THEN node - 1 END AS parent FROM ch JOIN m USING (g)")
def tree_reroot_covering(spark, sf_dir):
    """The root is the first node that holds the vertices of the last one."""
    _, tree = _chain(spark, sf_dir)
    tree = cut(tree, "tree")
    return trees.reroot_covering(tree, tree.groupBy("g").agg(F.max_by("bag", "node").alias("vertices"))).select("g", "node", "parent")


@query(
    f"{_HM}, {_CHAIN}, go AS (SELECT g, node, CAST(NULL AS BIGINT) AS parent, node AS kept, bag FROM ch WHERE node = 1 UNION ALL SELECT c.g, c.node, go.kept, CASE WHEN list_has_all(go.bag, c.bag) THEN go.kept ELSE c.node END, CASE WHEN list_has_all(go.bag, c.bag) THEN go.bag ELSE c.bag END"
    " FROM go JOIN ch c ON c.g = go.g AND c.node = go.node + 1) SELECT g, node, parent FROM go WHERE node = kept"
)
def tree_prune(spark, sf_dir):
    _, tree = _chain(spark, sf_dir)
    return trees.prune(cut(tree, "tree")).select("g", "node", "parent")


@query(f"{_HM}, {_CHAIN} SELECT g, node, array_to_string(list_filter(bag, lambda x: x > 3), ',') AS bag, e AS cover FROM ch")
def tree_without_vertices(spark, sf_dir):
    h, tree = _chain(spark, sf_dir)
    return trees.remove_vertices(tree, h.where("v <= 3").select("g", "v").distinct()).select("g", "node", _TEXT("bag").alias("bag"), F.element_at("cover", 1).alias("cover"))


@query(f"{_HM}, {_CHAIN} SELECT g, node, array_to_string(bag, ',') AS bag FROM ch")
def complete_mode(spark, sf_dir):
    """A fresh vertex in each edge, a tree over these graphs, and the fresh vertices out of it again."""
    h = inc.corpus(spark, sf_dir)
    more = inc.make_distinct(h)
    nodes = inc.edge_lists(more).join(inc.positions(more), ["g", "e"])
    tree = nodes.select("g", F.col("pos").cast("int").alias("node"), F.lit(None).cast("int").alias("parent"), F.col("vertices").alias("bag"), F.array("e").alias("cover"))
    fresh = more.select("g", "v").distinct().join(h.select("g", "v").distinct(), ["g", "v"], "left_anti")
    return trees.remove_vertices(tree, fresh).select("g", "node", _TEXT("bag").alias("bag"))


@query(f"{_HM}, {_CHAIN} SELECT g, node, array_to_string(bag, ',') AS bag FROM ch")
def types_restored_in_bags(spark, sf_dir):
    """Vertices of one type collapse, a tree is made over the representatives, and its bags get all vertices back."""
    h = inc.corpus(spark, sf_dir)
    kept, members = reductions.type_collapse(h)
    nodes = inc.edge_lists(kept).join(inc.positions(h), ["g", "e"])
    tree = nodes.select("g", F.col("pos").cast("int").alias("node"), F.lit(None).cast("int").alias("parent"), F.col("vertices").alias("bag"), F.array("e").alias("cover"))
    return trees.restore_types_in_bags(tree, members).select("g", "node", _TEXT("bag").alias("bag"))


@query(f"{_HM}, {_CHAIN}, l AS (SELECT pos.g, e, p, list(v) AS vs FROM inc JOIN pos USING (g, e) GROUP BY ALL) SELECT ch.g, node, arg_min(l.e, l.p) AS cover FROM ch JOIN l ON l.g = ch.g AND list_has_all(l.vs, ch.bag[2:]) GROUP BY ch.g, node")
def subedges_restored(spark, sf_dir):
    """Nodes covered by a subedge name the first edge that contains it."""
    h, tree = _chain(spark, sf_dir)
    parts = tree.select("g", "node", F.expr("slice(bag, 2, size(bag))").alias("vertices"))
    return trees.restore_subedges(parts, h).select("g", "node", F.col("e").alias("cover"))


# --- trees where the node n has the children 2n and 2n + 1 ---

_HEAP, _BROKEN_HEAP = (text.replace("p - 1 END AS parent", "p // 2 END AS parent") for text in (_CHAIN, _BROKEN))
_ABOVE = "k AS (SELECT unnest(range(0, 40)) AS k), up AS (SELECT g, node, node >> k AS top, k FROM ch, k WHERE node >> k > 0)"


@query(
    f"{_HM}, {_BROKEN_HEAP}, {_ABOVE}, f1 AS (SELECT DISTINCT g FROM bv ANTI JOIN cv USING (g, node, v)), f2 AS (SELECT DISTINCT g FROM br WHERE e = -1),"
    " hold AS (SELECT DISTINCT i.g, i.e FROM (SELECT g, e, list(v) AS vs FROM inc GROUP BY g, e) i JOIN br ON br.g = i.g AND list_has_all(br.bag, i.vs)), f3 AS (SELECT DISTINCT g FROM (SELECT DISTINCT g, e FROM inc) ANTI JOIN hold USING (g, e)),"
    " f4 AS (SELECT DISTINCT g FROM (SELECT a.g, a.v, count(*) FILTER (b.v IS NULL) AS tops FROM bv a LEFT JOIN bv b ON b.g = a.g AND b.v = a.v AND b.node = a.node // 2 GROUP BY ALL) WHERE tops != 1),"
    " f5 AS (SELECT DISTINCT m.g FROM (SELECT * FROM cv ANTI JOIN bv USING (g, node, v)) m JOIN up ON up.g = m.g AND up.top = m.node AND up.k > 0 JOIN bv ON bv.g = m.g AND bv.v = m.v AND bv.node = up.node),"
    " t AS (SELECT g, 1 AS width, g NOT IN (FROM f1) AS bags_covered, g NOT IN (FROM f2) AS covers_known, g NOT IN (FROM f3) AS edges_in_bags, g NOT IN (FROM f4) AS connected, g NOT IN (FROM f5) AS special_condition FROM (SELECT DISTINCT g FROM br))"
    " SELECT *, bags_covered AND covers_known AND edges_in_bags AND connected AS valid FROM t"
)
def branching_checks(spark, sf_dir):
    h, tree = _broken(spark, sf_dir, "pos DIV 2")
    return trees.validate(cut(tree, "tree"), h)


@query(f"{_HM}, {_HEAP}, {_ABOVE}, n AS (SELECT g, top AS node, count(*) AS below FROM up GROUP BY g, top), d AS (SELECT g, node, max(k)::INT AS depth FROM up GROUP BY g, node) SELECT g, node, depth, below FROM n JOIN d USING (g, node)")
def branching_intervals(spark, sf_dir):
    """Depth and number of nodes below, the node itself included, from the preorder numbers."""
    _, tree = _chain(spark, sf_dir, "pos DIV 2")
    return trees.intervals(cut(tree, "tree")).select("g", "node", "depth", F.expr("last - first + 1").alias("below"))


@query(
    f"{_HM}, {_HEAP}, {_ABOVE}, m AS (SELECT g, max(node) AS r FROM ch GROUP BY g), way AS (SELECT g, top AS node, r >> (k - 1) AS new FROM up JOIN m USING (g) WHERE node = r AND k > 0)"
    " SELECT g, node, CASE WHEN new IS NOT NULL THEN new WHEN node < r THEN parent END AS parent FROM ch JOIN m USING (g) LEFT JOIN way USING (g, node)"
)
def branching_reroot(spark, sf_dir):
    """The last node becomes the root."""
    _, tree = _chain(spark, sf_dir, "pos DIV 2")
    tree = cut(tree, "tree")
    return trees.reroot(tree, tree.groupBy("g").agg(F.max("node").alias("node"))).select("g", "node", "parent")


@query(
    f"{_HM}, {_HEAP}, go AS (SELECT g, node, CAST(NULL AS BIGINT) AS parent, node AS kept, bag FROM ch WHERE node = 1 UNION ALL SELECT c.g, c.node, go.kept, CASE WHEN list_has_all(go.bag, c.bag) THEN go.kept ELSE c.node END, CASE WHEN list_has_all(go.bag, c.bag) THEN go.bag ELSE c.bag END"
    " FROM go JOIN ch c ON c.g = go.g AND c.node // 2 = go.node) SELECT g, node, parent FROM go WHERE node = kept"
)
def branching_prune(spark, sf_dir):
    _, tree = _chain(spark, sf_dir, "pos DIV 2")
    return trees.prune(cut(tree, "tree")).select("g", "node", "parent")


@query(f"{_HM}, {_HEAP}, {_ABOVE}, d AS (SELECT g, node, max(k) AS depth FROM up GROUP BY g, node) SELECT g, node, repeat(chr(9), depth) || 'Bag: {{' || array_to_string(bag, ', ') || '}} Cover: {{' || e || '}}' AS text FROM ch JOIN d USING (g, node)")
def branching_text(spark, sf_dir):
    _, tree = _chain(spark, sf_dir, "pos DIV 2")
    return text_formats.tree_lines(cut(tree, "tree"))


@query(
    f"{_HM}, {_TYPES}, "
    + _gyo_sql("inc AS (SELECT inc.* FROM inc SEMI JOIN (SELECT g, rep AS v FROM mem) r USING (g, v))", 7)
    + ", m AS (SELECT g, count(DISTINCT e) AS m FROM inc GROUP BY g), n AS (SELECT g, count(DISTINCT e) AS n FROM i7 GROUP BY g)"
    " SELECT g, greatest(1, coalesce(n, 0))::INT AS width, m - coalesce(n, 0) + (n IS NOT NULL)::INT AS nodes, true AS bags_covered, true AS covers_known, true AS edges_in_bags, true AS connected, true AS special_condition, true AS valid FROM m LEFT JOIN n USING (g)"
)
def reduction_undone(spark, sf_dir):
    """Type collapse, reduction, one node for the residue, the reduction undone and the types back: a valid tree of the whole graph, a join tree where the residue is empty."""
    h = cut(inc.corpus(spark, sf_dir), "graphs")
    kept, members = reductions.type_collapse(h)
    kept = cut(kept, "representatives")
    residue, log = reductions.gyo_logged(kept)
    one = residue.groupBy("g").agg(F.array_sort(F.collect_set("v")).alias("bag"), F.array_sort(F.collect_set("e")).alias("cover"))
    tree = one.select("g", F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), "bag", "cover")
    whole = cut(trees.restore_types_in_bags(reductions.undo_gyo(tree, kept, residue, log), members), "tree")
    return trees.validate(whole, h).join(whole.groupBy("g").agg(F.count("*").alias("nodes")), "g")


@query(
    f"{_HM}, w0 AS (FROM inc), {_TYPES}, "
    + _gyo_sql("inc AS (SELECT inc.* FROM inc SEMI JOIN (SELECT g, rep AS v FROM mem) r USING (g, v))", 7)
    + ", n AS (SELECT g, count(DISTINCT e) AS n, count(DISTINCT v) AS held FROM i7 GROUP BY g), o AS (SELECT g, n, CASE WHEN g % 5 = 0 OR (g % 5 = 4 AND n IS NULL) OR (g % 5 IN (1, 2) AND held = m.v) THEN 'pruned' WHEN g % 5 < 3 AND n IS NOT NULL THEN 'lifted' ELSE 'broken' END AS outcome"
    " FROM (SELECT g, count(DISTINCT e) AS m, count(DISTINCT v) AS v FROM w0 GROUP BY g) m LEFT JOIN n USING (g) WHERE CASE g % 5 WHEN 0 THEN true WHEN 4 THEN m > coalesce(n, 0) ELSE n IS NOT NULL END)"
    " SELECT g, outcome, CASE WHEN outcome != 'broken' THEN greatest(1, coalesce(n, 0))::INT END AS width, CASE WHEN outcome != 'broken' THEN true END AS valid FROM o"
)
def tree_repair(spark, sf_dir):
    """Trees by g % 5: 0 whole ones with a needless leaf below each node; 1 and 2 those of reduced graphs (trees of the whole ones too, where no vertex was removed); 3 the same without their covers; 4 whole ones in which the residual edges' node is gone, so that only join trees are left whole."""
    h = cut(inc.corpus(spark, sf_dir), "graphs")
    kept, members = reductions.type_collapse(h)
    kept = cut(kept, "representatives")
    residue, log = reductions.gyo_logged(kept)
    one = residue.groupBy("g").agg(F.array_sort(F.collect_set("v")).alias("bag"), F.array_sort(F.collect_set("e")).alias("cover"))
    small = cut(one.select("g", F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), "bag", "cover"), "trees")
    whole = cut(trees.restore_types_in_bags(reductions.undo_gyo(small, kept, residue, log), members), "trees")
    leaves = whole.select("g", (-1 - F.col("node")).alias("node"), F.col("node").alias("parent"), F.expr("slice(bag, 1, 1)").alias("bag"), "cover")
    held = small.select("g").withColumn("gone", F.lit(True))
    fourth = whole.join(held, "g", "left").where("gone IS NULL OR parent IS NOT NULL").drop("gone")
    read = whole.union(leaves).where("g % 5 = 0").union(small.where("g % 5 IN (1, 2)")).union(small.where("g % 5 = 3").withColumn("cover", F.array().cast("array<bigint>"))).union(fourth.where("g % 5 = 4"))
    outcomes, made = repair.repair(read, h)
    return outcomes.join(trees.validate(made, h).select("g", "width", "valid"), "g", "left")


_VALID = "ok AS (SELECT g, bool_and(k) AS valid FROM (SELECT g, v, max(node) - min(node) + 1 = count(*) AS k FROM (SELECT g, node, unnest(bag) AS v FROM ch) GROUP BY g, v) GROUP BY g)"
_GML = (
    "tx AS (SELECT g, 'graph [' || chr(10) || '  directed 0' || chr(10) || string_agg('  node [' || chr(10) || '    id ' || node || chr(10) || '    label \"{' || e || '}{' || array_to_string(bag, ', ') || '}\"' || chr(10) || '  ]' || chr(10), '' ORDER BY node)"
    " || coalesce(string_agg('  edge [' || chr(10) || '    source ' || parent || chr(10) || '    target ' || node || chr(10) || '  ]' || chr(10), '' ORDER BY node) FILTER (parent IS NOT NULL), '') || ']' || chr(10) AS gml FROM ch GROUP BY g)"
)


@query(f"{_HM}, {_CHAIN}, {_VALID}, {_GML} SELECT g, 1 AS width, valid, CASE WHEN valid THEN gml END AS gml FROM ok JOIN tx USING (g)")
def result_stanza(spark, sf_dir):
    """Width, validity, and the tree as GML only where it is valid."""
    h, tree = _chain(spark, sf_dir)
    tree = cut(tree, "tree")
    return trees.validate(tree, h).join(text_formats.tree_gml(tree), "g").select("g", "width", "valid", F.expr("CASE WHEN valid THEN gml END").alias("gml"))


@query(f"{_HM}, {_CHAIN} SELECT g, node, parent, array_to_string(bag, ',') AS bag, e::VARCHAR AS cover FROM ch")
def gml_roundtrip(spark, sf_dir):
    _, tree = _chain(spark, sf_dir)
    return text_formats.tree_from_gml(text_formats.tree_gml(tree)).select("g", "node", "parent", _TEXT("bag").alias("bag"), _TEXT("cover").alias("cover"))


@query(f"{_HM}, {_CHAIN} SELECT g, node - 1 AS node, parent - 1 AS parent, array_to_string(bag, ',') AS bag, e::VARCHAR AS cover FROM ch")
def json_roundtrip(spark, sf_dir):
    """Nodes are numbered from 0 as they are read."""
    _, tree = _chain(spark, sf_dir)
    return text_formats.tree_from_json(text_formats.tree_json(tree)).select("g", "node", "parent", _TEXT("bag").alias("bag"), _TEXT("cover").alias("cover"))


@query(f"{_HM}, {_CHAIN} SELECT g, node, repeat(chr(9), node - 1) || 'Bag: {{' || array_to_string(bag, ', ') || '}} Cover: {{' || e || '}}' AS text FROM ch")
def tree_text(spark, sf_dir):
    _, tree = _chain(spark, sf_dir)
    return text_formats.tree_lines(cut(tree, "tree"))


# --- text formats ---

_NAMES = "nv AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY min(e), v) AS n FROM inc GROUP BY g, v)"


@query(f"{_HP}, {_POS}, {_NAMES} SELECT g, 'E' || p AS edge, string_agg('V' || n, ',' ORDER BY n) AS vertices FROM inc JOIN pos USING (g, e) JOIN nv USING (g, v) GROUP BY g, p")
def pace_roundtrip(spark, sf_dir):
    texts = text_formats.to_pace(inc.corpus(spark, sf_dir, "hp")).select(F.col("g").cast("string").alias("name"), "text")
    back = text_formats.labelled_edges(texts, "pace")
    ordered = back.groupBy(F.col("name").cast("long").alias("g"), "edge").agg(F.array_sort(F.collect_list(F.struct("pos", "vertex")))["vertex"].alias("vs"))
    return ordered.select("g", "edge", _TEXT("vs").alias("vertices"))


def _labelled(spark, sf_dir) -> DataFrame:
    texts = text_formats.to_hyperbench(inc.corpus(spark, sf_dir)).select(F.col("g").cast("string").alias("name"), "text")
    return text_formats.labelled_edges(texts)


_DICT = f"{_POS}, {_NAMES}, di AS (SELECT g, n AS id, 'V' || v AS label, 'V' AS kind FROM nv UNION ALL SELECT g, p + (SELECT count(*) FROM nv WHERE nv.g = pos.g), 'E' || e, 'E' FROM pos)"


@query(f"{_HM}, {_DICT} SELECT * FROM di")
def label_dictionary(spark, sf_dir):
    return text_formats.dictionary(_labelled(spark, sf_dir)).select(F.col("name").cast("long").alias("g"), "id", "label", "kind")


@query(f"{_HM}, {_DICT} SELECT inc.g, x.id AS e, y.id AS v FROM inc JOIN di x ON x.g = inc.g AND x.label = 'E' || e JOIN di y ON y.g = inc.g AND y.label = 'V' || v")
def label_encoding(spark, sf_dir):
    labelled = cut(_labelled(spark, sf_dir), "labelled")
    return text_formats.encode(labelled, text_formats.dictionary(labelled)).select(F.col("name").cast("long").alias("g"), "e", "v")


@query(f"{_HM} SELECT * FROM inc")
def transparent_encoding(spark, sf_dir):
    """Labels that end in a number keep it as their id."""
    return text_formats.transparent(_labelled(spark, sf_dir)).select(F.col("name").cast("long").alias("g"), "e", "v")


@query(f"{_HM} SELECT g, 'E' || e AS edge, string_agg('V' || v, ',' ORDER BY v) AS vertices FROM inc GROUP BY g, e UNION ALL SELECT DISTINCT g, 'Extra', 'V1,New' FROM inc")
def extra_edge(spark, sf_dir):
    labelled = cut(_labelled(spark, sf_dir), "labelled")
    more = text_formats.add_edges(labelled, labelled.select("name").distinct().withColumn("text", F.lit("Extra(V1, New).")))
    ordered = more.groupBy(F.col("name").cast("long").alias("g"), "edge").agg(F.array_sort(F.collect_list(F.struct("pos", "vertex")))["vertex"].alias("vs"))
    return ordered.select("g", "edge", _TEXT("vs").alias("vertices"))


@query(f"{_HM}, {_DICT}, n AS (SELECT g, p, e, lead(e) OVER (PARTITION BY g ORDER BY p) AS f, count(*) OVER (PARTITION BY g ORDER BY p) + (SELECT count(*) FROM nv WHERE nv.g = pos.g) AS id FROM pos) SELECT g, id || ',' || (id + 1) AS s, (e % 97 + f % 97) / 2.0 AS cost FROM n WHERE f IS NOT NULL")
def join_costs(spark, sf_dir):
    """A cost file for the pairs of neighbouring edges, read with the labels of the graph's own file."""
    from pyspark.sql import Window

    h = inc.corpus(spark, sf_dir)
    pairs = inc.positions(h).withColumn("f", F.lead("e").over(Window.partitionBy("g").orderBy("e"))).where("f IS NOT NULL")
    lines = pairs.select("g", F.expr("concat('E', f, ', E', e, ',', (e % 97 + f % 97) / 2)").alias("line")).groupBy("g").agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    names = text_formats.dictionary(_labelled(spark, sf_dir))
    return text_formats.read_costs(lines.select(F.col("g").cast("string").alias("name"), "text"), names).select(F.col("name").cast("long").alias("g"), "s", "cost")


# --- subedges and special edges ---

_SUBEDGES = (
    "el AS (SELECT g, e, list(v ORDER BY v) AS vs FROM inc GROUP BY g, e), ix AS (SELECT a.g, a.e, b.e AS f, list(a.v ORDER BY a.v) AS s FROM inc a JOIN inc b ON a.g = b.g AND a.v = b.v AND a.e != b.e GROUP BY ALL),"
    " ba AS (SELECT DISTINCT ix.g, ix.e, s FROM ix JOIN el USING (g, e) WHERE len(s) < len(vs)), un AS (SELECT DISTINCT a.g, a.e, list_sort(list_distinct(list_concat(a.s, b.s))) AS u FROM ba a JOIN ba b ON a.g = b.g AND a.e = b.e),"
    " ms AS (SELECT g, e, u, unnest(range(1, 1 << len(u))) AS m FROM un), se AS (SELECT DISTINCT ms.g, ms.e, array_to_string(list_filter(u, lambda v, i: (m >> (i - 1)) & 1 = 1), ',') AS subset FROM ms),"
    " fu AS (SELECT g, e, array_to_string(vs, ',') AS subset FROM el), sub AS (SELECT * FROM se ANTI JOIN fu USING (g, e, subset))"
)


@query(f"{_HM}, {_SUBEDGES} SELECT * FROM sub")
def subedges_of_edges(spark, sf_dir):
    return comp.subedges(inc.corpus(spark, sf_dir), 2).select("g", "e", _TEXT("subset").alias("subset"))


@query(f"{_HM}, {_SUBEDGES} SELECT g, min(e) AS e, subset FROM (SELECT * FROM sub UNION ALL SELECT * FROM fu) GROUP BY g, subset")
def subedge_closure(spark, sf_dir):
    return comp.subedge_closure(inc.corpus(spark, sf_dir), 2).select("g", "e", _TEXT("subset").alias("subset"))


_SPECIAL = (
    f"{_LOW}, sp AS (SELECT DISTINCT g, -((p + 1) // 2) AS e, v FROM inc JOIN pos USING (g, e) WHERE p BETWEEN 1 AND 6), ao AS (SELECT g, e, v FROM inc UNION ALL SELECT g, e, v FROM sp), rest AS (SELECT * FROM ao ANTI JOIN sv USING (g, v)),"
    " link AS (SELECT DISTINCT a.g, a.e AS x, b.e AS y FROM rest a JOIN rest b ON a.g = b.g AND a.v = b.v), reach AS (SELECT g, x, y FROM link UNION SELECT r.g, r.x, l.y FROM reach r JOIN link l ON l.g = r.g AND l.x = r.y),"
    " lab AS (SELECT g, x AS e, min(y) AS comp FROM reach GROUP BY g, x UNION ALL SELECT g, e, e FROM (SELECT DISTINCT g, e FROM sp) ANTI JOIN rest USING (g, e))"
)


def _specials(spark, sf_dir):
    """Special edges -1, -2, -3: the vertices of each graph's edges 1 and 2, 3 and 4, 5 and 6; the separator is the first of them."""
    h, sep = _low(spark, sf_dir)
    pairs = h.join(inc.positions(h).where("pos <= 6"), ["g", "e"]).selectExpr("g", "-(CAST(pos + 1 AS BIGINT) DIV 2) AS e", "v").distinct()
    return h, pairs, sep.select("g", F.lit("low").alias("s"), "v")


@query(f"{_HM}, {_SPECIAL} SELECT * FROM lab")
def components_with_specials(spark, sf_dir):
    return comp.components_with_specials(*_specials(spark, sf_dir)).select("g", "e", "comp")


@query(
    f"{_HM}, {_SPECIAL}, big AS (SELECT g, max(n) AS n FROM (SELECT g, comp, count(*) AS n FROM lab GROUP BY ALL) GROUP BY g), tot AS (SELECT g, count(DISTINCT e) AS m FROM ao GROUP BY g),"
    " same AS (SELECT g FROM (SELECT g, e, string_agg(v, ',' ORDER BY v) AS t FROM sp GROUP BY g, e) JOIN (SELECT g, string_agg(v, ',' ORDER BY v) AS u FROM sv GROUP BY g) USING (g) WHERE t = u)"
    " SELECT g, coalesce(n, 0) <= m // 2 AS small_parts, coalesce(n, 0) <= m // 2 AND g NOT IN (FROM same) AS balanced FROM tot LEFT JOIN big USING (g)"
)
def balance_with_specials(spark, sf_dir):
    return comp.balance_with_specials(*_specials(spark, sf_dir)).select("g", "small_parts", "balanced")


@query()
def max_cardinality_order(spark, sf_dir):
    return search_orders.msc_order(inc.corpus(spark, sf_dir))


@query(f"{_REDUCED}, {_HINGE} SELECT g, part, edges FROM big")
def largest_hinge(spark, sf_dir):
    """The hinge with most edges of each reduced graph; of equal ones the first."""
    return hinges.largest_hinge(hinges.hinge_tree(reductions.gyo(inc.corpus(spark, sf_dir))))


@query(
    f"{_HM}, {_TYPES}, "
    + _gyo_sql("inc AS (SELECT inc.* FROM inc SEMI JOIN (SELECT g, rep AS v FROM mem) r USING (g, v))", 7).replace("inc AS", "i AS", 1)
    + f", {_HINGE.replace('FROM inc', 'FROM i7').replace('JOIN inc', 'JOIN i7')}, y AS (SELECT i7.* FROM i7 JOIN hi USING (g, e) JOIN big USING (g, part)),"
    " s AS (SELECT g, e, count(*) AS arity FROM y GROUP BY g, e), a AS (SELECT g, avg(arity) AS avg_arity, count(*) AS edges, max(arity) AS max_arity, sum(arity)::BIGINT AS sum_arity FROM s GROUP BY g),"
    " b AS (SELECT g, count(*) AS vertices, max(degree) AS max_degree FROM (SELECT g, v, count(*) AS degree FROM y GROUP BY g, v) GROUP BY g) SELECT * FROM a JOIN b USING (g)"
)
def stats_largest_hinge(spark, sf_dir):
    """Statistics of the largest hinge of what type collapse and the acyclicity reduction leave."""
    residue = cut(reductions.gyo(reductions.type_collapse(inc.corpus(spark, sf_dir))[0]), "residue")
    tree = cut(hinges.hinge_tree(residue), "hinges")
    largest = tree.join(hinges.largest_hinge(tree), ["g", "part"], "left_semi").select("g", "e")
    return inc.statistics(residue.join(largest, ["g", "e"], "left_semi"))
