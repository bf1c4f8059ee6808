"""Queries over hypergraphs derived from the order tables, and the SQL they equal.

Graph = customer, edge = order, vertices from the line items (``incidence.CORPORA``). Lists are given as text, so that values compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.functions import sets
from hyperloom.operators import components as comp
from hyperloom.operators import distances, frontier, hinges, reductions, solvers, trees
from hyperloom.operators import incidence as inc
from hyperloom.sources import text_formats
from hyperloom.storage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_HM, _HS, _HP = (
    f"inc AS (SELECT DISTINCT o_custkey::BIGINT AS g, l_orderkey::BIGINT AS e, ({expr})::BIGINT AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)" for expr in inc.CORPORA.values()
)
_POS = "pos AS (SELECT g, e, row_number() OVER (PARTITION BY g ORDER BY e) AS p FROM (SELECT DISTINCT g, e FROM inc))"
_LOW = _POS + ", sv AS (SELECT DISTINCT g, v FROM inc JOIN pos USING (g, e) WHERE p <= 2)"
_DEG = "deg AS (SELECT g, v, count(DISTINCT e) AS degree FROM inc GROUP BY g, v)"
_OVER = "ov AS (SELECT a.g, a.e AS e1, b.e AS e2, count(*) AS shared FROM inc a JOIN inc b ON a.g = b.g AND a.v = b.v AND a.e != b.e GROUP BY ALL)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {sql}"
        return f

    return add


@query(f"{_HM} SELECT * FROM inc")
def incidence(spark, sf_dir):
    return inc.corpus(spark, sf_dir)


@query(f"{_HM}, {_DEG} SELECT * FROM deg")
def vertex_degree(spark, sf_dir):
    return inc.vertex_degree(inc.corpus(spark, sf_dir))


@query(f"{_HM}, {_OVER}, n AS (SELECT g, e1 AS e, count(*) AS n FROM ov GROUP BY ALL) SELECT DISTINCT g, e, coalesce(n, 0) + 1 AS degree FROM inc LEFT JOIN n USING (g, e)")
def edge_degree(spark, sf_dir):
    return inc.edge_degree(inc.corpus(spark, sf_dir))


@query(f"{_HM}, {_DEG} SELECT g, e, (sum(degree) - count(*))::BIGINT AS weight FROM inc JOIN deg USING (g, v) GROUP BY g, e")
def edge_vertex_degree(spark, sf_dir):
    return inc.edge_vertex_degree(inc.corpus(spark, sf_dir))


@query(f"{_HM} SELECT g, e, count(*) AS arity FROM inc GROUP BY g, e")
def edge_arity(spark, sf_dir):
    return inc.sizes(inc.corpus(spark, sf_dir))


@query(f"{_HM}, {_OVER} SELECT * FROM ov WHERE e1 < e2")
def pairwise_intersection(spark, sf_dir):
    return inc.pairwise_intersections(inc.corpus(spark, sf_dir))


@query(f"{_HS}, {_OVER}, m AS (SELECT g, max(shared) AS m FROM ov GROUP BY g) SELECT DISTINCT g, coalesce(m, 0) AS bip FROM inc LEFT JOIN m USING (g)")
def bip_per_graph(spark, sf_dir):
    return inc.bip(inc.corpus(spark, sf_dir, "hs"))


@query(
    f"{_HM}, {_DEG}, s AS (SELECT g, e, count(*) AS arity FROM inc GROUP BY g, e), a AS (SELECT g, avg(arity) AS avg_arity, count(*) AS edges, max(arity) AS max_arity, sum(arity)::BIGINT AS sum_arity FROM s GROUP BY g),"
    " b AS (SELECT g, count(*) AS vertices, max(degree) AS max_degree FROM deg GROUP BY g) SELECT * FROM a JOIN b USING (g)"
)
def graph_stats(spark, sf_dir):
    return inc.statistics(inc.corpus(spark, sf_dir))


def _low(spark, sf_dir, kind="hm"):
    h = inc.corpus(spark, sf_dir, kind)
    return h, inc.separator_vertices(h, inc.lowest_edges(h, 2))


@query(f"{_HS}, {_LOW} SELECT * FROM inc WHERE (g, e) IN (SELECT g, e FROM inc JOIN sv USING (g, v))")
def filter_intersecting(spark, sf_dir):
    return inc.filter_intersecting(*_low(spark, sf_dir, "hs"))


@query(f"{_HM}, {_LOW} SELECT * FROM inc WHERE (g, e) NOT IN (SELECT g, e FROM inc ANTI JOIN sv USING (g, v))")
def filter_contained(spark, sf_dir):
    return inc.filter_contained(*_low(spark, sf_dir))


@query(f"{_HM}, {_LOW} SELECT * FROM inc SEMI JOIN sv USING (g, v)")
def cut_edges(spark, sf_dir):
    return inc.cut_edges(*_low(spark, sf_dir))


@query(f"{_HM}, {_POS} SELECT inc.* FROM inc JOIN pos USING (g, e) WHERE p > 2")
def edge_except(spark, sf_dir):
    h = inc.corpus(spark, sf_dir)
    return inc.except_edges(h, inc.lowest_edges(h, 2))


@query(f"{_HM}, l AS (SELECT g, e, string_agg(v, ',' ORDER BY v) AS vertices FROM inc GROUP BY g, e) SELECT g, min(e) AS e, vertices FROM l GROUP BY g, vertices")
def distinct_edges(spark, sf_dir):
    return inc.distinct_edges(inc.corpus(spark, sf_dir)).select("g", "e", F.array_join("vertices", ",").alias("vertices"))


@query(f"{_HM}, {_LOW} SELECT g, string_agg(v, ',' ORDER BY v) AS vertices FROM sv GROUP BY g")
def edge_union(spark, sf_dir):
    _, v = _low(spark, sf_dir)
    return v.groupBy("g").agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias("vertices"))


_SUB = "sz AS (SELECT g, e, count(*) AS n FROM inc GROUP BY g, e), sub AS (SELECT ov.g, e1 AS e, arg_max(e2, b.n * 1000000000000 + e2) AS parent FROM ov JOIN sz a ON a.g = ov.g AND a.e = e1 JOIN sz b ON b.g = ov.g AND b.e = e2 WHERE shared = a.n AND (b.n > a.n OR e2 > e1) GROUP BY ALL)"


@query(f"{_HM}, {_OVER}, {_SUB} SELECT * FROM sub")
def subsumed_edges(spark, sf_dir):
    return reductions.subsumed_edges(inc.corpus(spark, sf_dir))


@query(f"{_HS}, {_DEG} SELECT g, v FROM deg WHERE degree = 1")
def degree_one_vertices(spark, sf_dir):
    return reductions.lonely_vertices(inc.corpus(spark, sf_dir, "hs"))


def _gyo_sql(corpus: str, rounds: int) -> str:
    parts = [corpus.replace("inc AS", "i0 AS MATERIALIZED", 1)]
    for k in range(rounds):
        parts += [
            f"s{k} AS MATERIALIZED (SELECT g, e, count(*) AS n FROM i{k} GROUP BY g, e)",
            f"o{k} AS MATERIALIZED (SELECT a.g, a.e AS e1, b.e AS e2, count(*) AS shared FROM i{k} a JOIN i{k} b ON a.g = b.g AND a.v = b.v AND a.e != b.e GROUP BY ALL)",
            f"d{k} AS MATERIALIZED (SELECT DISTINCT o.g, e1 AS e FROM o{k} o JOIN s{k} x ON x.g = o.g AND x.e = e1 JOIN s{k} y ON y.g = o.g AND y.e = e2 WHERE shared = x.n AND (y.n > x.n OR e2 > e1))",
            f"r{k} AS MATERIALIZED (SELECT * FROM i{k} ANTI JOIN d{k} USING (g, e))",
            f"i{k + 1} AS MATERIALIZED (SELECT r.* FROM r{k} r SEMI JOIN (SELECT g, v FROM r{k} GROUP BY g, v HAVING count(*) > 1) m USING (g, v))",
        ]
    return ", ".join(parts)


@query(f"{_gyo_sql(_HM, 1)} SELECT * FROM i1")
def gyo_one_round(spark, sf_dir):
    return reductions.gyo_round(inc.corpus(spark, sf_dir))


@query(f"{_gyo_sql(_HS, 9)} SELECT * FROM i9")
def gyo_residual(spark, sf_dir):
    return reductions.gyo(inc.corpus(spark, sf_dir, "hs"))


def _acyclic_sql(corpus: str, rounds: int) -> str:
    return f"{_gyo_sql(corpus, rounds)}, n AS (SELECT g, count(DISTINCT e) AS n FROM i{rounds} GROUP BY g) SELECT DISTINCT g, n IS NULL AS is_acyclic, coalesce(n, 0) AS residual_edges FROM i0 LEFT JOIN n USING (g)"


@query(_acyclic_sql(_HM, 6))
def is_acyclic(spark, sf_dir):
    h = inc.corpus(spark, sf_dir)
    return reductions.acyclic(h, reductions.gyo(h))


@query(_acyclic_sql(_HP, 6))
def is_acyclic_parts(spark, sf_dir):
    h = inc.corpus(spark, sf_dir, "hp")
    return reductions.acyclic(h, reductions.gyo(h))


_TYPES = "ty AS (SELECT g, v, string_agg(e, ',' ORDER BY e) AS edges FROM inc GROUP BY g, v), mem AS (SELECT g, min(v) OVER (PARTITION BY g, edges) AS rep, v FROM ty)"


@query(f"{_HM}, {_TYPES} SELECT * FROM mem")
def type_collapse(spark, sf_dir):
    return reductions.type_collapse(inc.corpus(spark, sf_dir))[1]


@query(f"{_HM} SELECT * FROM inc")
def type_restore_roundtrip(spark, sf_dir):
    return reductions.restore_types(*reductions.type_collapse(inc.corpus(spark, sf_dir)))


def _components_sql(corpus: str, low: bool) -> str:
    rest = f"{_LOW}, rest AS (SELECT * FROM inc ANTI JOIN sv USING (g, v))" if low else "rest AS (SELECT * FROM inc)"
    return f"{corpus}, {rest}, link AS (SELECT DISTINCT a.g, a.e AS x, b.e AS y FROM rest a JOIN rest b ON a.g = b.g AND a.v = b.v), reach AS (SELECT g, x, y FROM link UNION SELECT r.g, r.x, l.y FROM reach r JOIN link l ON l.g = r.g AND l.x = r.y), lab AS (SELECT g, x AS e, min(y) AS comp FROM reach GROUP BY g, x)"


@query(f"{_components_sql(_HS, False)} SELECT * FROM lab")
def components(spark, sf_dir):
    return comp.whole(inc.corpus(spark, sf_dir, "hs")).select("g", "e", "comp")


@query(f"{_components_sql(_HS, True)} SELECT g, comp, count(*) AS size FROM lab GROUP BY g, comp")
def component_sizes(spark, sf_dir):
    return comp.without_lowest(inc.corpus(spark, sf_dir, "hs")).groupBy("g", "comp").agg(F.count("*").alias("size"))


_COMBOS = "ed AS (SELECT DISTINCT g, e FROM inc), cand AS (SELECT g, e::VARCHAR AS s, e AS e1, e AS e2, 1 AS size FROM ed UNION ALL SELECT a.g, a.e || ',' || b.e, a.e, b.e, 2 FROM ed a JOIN ed b ON a.g = b.g AND a.e < b.e)"


@query(f"{_HM}, {_COMBOS} SELECT g, s, count(*) AS vertices FROM (SELECT DISTINCT c.g, c.s, i.v FROM cand c JOIN inc i ON i.g = c.g AND i.e IN (c.e1, c.e2)) GROUP BY ALL")
def separator_candidates(spark, sf_dir):
    return comp.separator_sizes(inc.corpus(spark, sf_dir))


_BALANCED = (
    _COMBOS + ", sv AS (SELECT DISTINCT c.g, c.s, i.v FROM cand c JOIN inc i ON i.g = c.g AND i.e IN (c.e1, c.e2)), rest AS MATERIALIZED (SELECT c.g, c.s, i.e, i.v FROM cand c JOIN inc i USING (g) ANTI JOIN sv USING (g, s, v)),"
    " link AS MATERIALIZED (SELECT DISTINCT a.g, a.s, a.e AS x, b.e AS y FROM rest a JOIN rest b USING (g, s, v)), reach AS (SELECT * FROM link UNION SELECT r.g, r.s, r.x, l.y FROM reach r JOIN link l ON l.g = r.g AND l.s = r.s AND l.x = r.y),"
    " cs AS (SELECT g, s, c, count(*) AS n FROM (SELECT g, s, x, min(y) AS c FROM reach GROUP BY ALL) GROUP BY ALL), big AS (SELECT g, s, max(n) AS largest FROM cs GROUP BY g, s), tot AS (SELECT g, count(*) AS m FROM ed GROUP BY g),"
    " bal AS (SELECT c.g, c.s, c.size::BIGINT AS size, coalesce(largest, 0) AS largest FROM cand c LEFT JOIN big USING (g, s) JOIN tot USING (g) WHERE coalesce(largest, 0) <= m // 2)"
)


def _reduced(spark, sf_dir):
    return reductions.gyo(inc.corpus(spark, sf_dir))


@query(f"{_gyo_sql(_HM, 5)}, inc AS MATERIALIZED (SELECT * FROM i5), {_BALANCED} SELECT * FROM bal")
def balanced_separators(spark, sf_dir):
    return comp.balanced_sets(_reduced(spark, sf_dir), 2)


_COST = "1.0 * sum(e % 97)"


@query(f"{_gyo_sql(_HM, 5)}, inc AS MATERIALIZED (SELECT * FROM i5), {_BALANCED}, c AS (SELECT bal.g, bal.s, (CASE WHEN e1 = e2 THEN e1 % 97 ELSE e1 % 97 + e2 % 97 END)::DOUBLE AS cost FROM bal JOIN cand USING (g, s)) SELECT g, s, cost FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY cost, s) = 1")
def best_separator_by_cost(spark, sf_dir):
    found = cut(comp.balanced_sets(_reduced(spark, sf_dir), 2), "balanced")
    costs = found.select("g", "s", F.expr("aggregate(transform(split(s, ','), x -> CAST(x AS bigint) % 97), 0L, (a, x) -> a + x)").cast("double").alias("cost"))
    return comp.by_cost(found, costs).where("rank = 1").select("g", "s", "cost")


@query(
    f"{_gyo_sql(_HM, 5)}, inc AS MATERIALIZED (SELECT * FROM i5), {_BALANCED}, c AS (SELECT cand.g, cand.s, bal.s IS NOT NULL AS hit, (CASE WHEN e1 = e2 THEN e1 % 97 ELSE e1 % 97 + e2 % 97 END)::DOUBLE AS cost FROM cand LEFT JOIN bal USING (g, s)),"
    " b AS (SELECT g, min(cost) FILTER (hit) AS best FROM c GROUP BY g), lo AS (SELECT g, coalesce(min(e % 97) FILTER (e % 97 > 0), 0)::DOUBLE AS base FROM ed GROUP BY g),"
    " h AS (SELECT g, best, min(base * pow(4, t)) FILTER (base * pow(4, t) >= best) AS high FROM b JOIN lo USING (g), range(0, 12) r(t) GROUP BY g, best)"
    " SELECT h.g, min(s) FILTER (hit AND cost = best) AS s, best AS cost, count(*) FILTER (best IS NULL OR cost <= high) AS tested FROM h JOIN c USING (g) GROUP BY h.g, best"
)
def cheapest_separator(spark, sf_dir):
    """The separator of ``best_separator_by_cost``, found by rising cost, and the number of candidates that it took."""
    h = cut(_reduced(spark, sf_dir), "residue")
    return comp.cheapest_balanced(h, h.select("g", "e", (F.col("e") % 97).cast("double").alias("cost")).distinct())


@query(
    f"{_gyo_sql(_HM, 5)}, inc AS MATERIALIZED (SELECT * FROM i5), {_BALANCED}, place AS (SELECT g, e, row_number() OVER (PARTITION BY g ORDER BY e) - 1 AS p, count(*) OVER (PARTITION BY g) AS m FROM ed),"
    " r AS (SELECT c.g, c.s, CASE WHEN c.e1 = c.e2 THEN a.m * (a.m - 1) // 2 + a.p ELSE b.p * (b.p - 1) // 2 + a.p END AS rank, a.m FROM cand c JOIN place a ON a.g = c.g AND a.e = c.e1 JOIN place b ON b.g = c.g AND b.e = c.e2)"
    " SELECT r.g, min(rank) FILTER (bal.s IS NOT NULL)::BIGINT AS rank, count(*) AS candidates FROM r LEFT JOIN bal ON bal.g = r.g AND bal.s = r.s GROUP BY r.g"
)
def first_balanced_separator(spark, sf_dir):
    """The smallest rank (pairs first, then single edges) of a balanced separator of each reduced graph, looking at no more blocks of ranks than it takes."""
    problems = frontier.whole_graphs(_reduced(spark, sf_dir))
    counts = problems.select("g", frontier.candidate_count(F.size("parts"), 2).alias("candidates"))
    return frontier.first_balanced(problems, 2).join(counts, "g").select("g", "rank", "candidates")


@query()
def frontier_k2(spark, sf_dir):
    """Trees of width 2 by separators of whole edges, all graphs and subproblems in common rounds: reduction, search, and the reduction undone. The verdict, the size of the whole graph's tree and whether it is valid."""
    h = cut(inc.corpus(spark, sf_dir), "graphs")
    residue, log = reductions.gyo_logged(h)
    verdicts, found = frontier.decompose(residue, 2)
    made = cut(reductions.undo_gyo(found, h, residue, log), "trees")
    sizes = made.groupBy("g").agg(F.count("*").alias("nodes"))
    said = h.select("g").distinct().join(verdicts, "g", "left").select("g", F.coalesce("verdict", F.lit("yes")).alias("verdict"))
    return said.join(sizes, "g", "left").join(trees.validate(made, h).select("g", "width", "valid"), "g", "left")


@query(f"{_HM}, {_DEG}, w AS (SELECT g, e, sum(degree) - count(*) AS w FROM inc JOIN deg USING (g, v) GROUP BY g, e) SELECT g, e, row_number() OVER (PARTITION BY g ORDER BY w DESC, e)::INT AS rank FROM w")
def heuristic_degree_order(spark, sf_dir):
    return inc.edge_order(inc.corpus(spark, sf_dir), "vertex_degree")


@query(f"{_HM}, {_OVER}, n AS (SELECT g, e1 AS e, count(*) AS n FROM ov GROUP BY ALL), w AS (SELECT DISTINCT g, e, coalesce(n, 0) AS w FROM inc LEFT JOIN n USING (g, e)) SELECT g, e, row_number() OVER (PARTITION BY g ORDER BY w DESC, e)::INT AS rank FROM w")
def heuristic_edge_degree_order(spark, sf_dir):
    return inc.edge_order(inc.corpus(spark, sf_dir), "edge_degree")


@query(f"{_HM}, adj AS (SELECT DISTINCT a.g, a.v AS a, b.v AS b FROM inc a JOIN inc b ON a.g = b.g AND a.e = b.e AND a.v != b.v), walk AS (SELECT g, a, b, 1 AS dist FROM adj UNION SELECT w.g, w.a, d.b, dist + 1 FROM walk w JOIN adj d ON d.g = w.g AND d.a = w.b WHERE dist < 9 AND d.b != w.a) SELECT g, a, b, min(dist)::INT AS dist FROM walk GROUP BY g, a, b")
def primal_distance(spark, sf_dir):
    return distances.primal_distances(inc.corpus(spark, sf_dir))


@query(f"{_HM}, {_POS}, b AS (SELECT DISTINCT g, (p > 2)::INT AS node, e, v FROM inc JOIN pos USING (g, e)) SELECT g, node, string_agg(DISTINCT v, ',' ORDER BY v) AS bag, count(DISTINCT e) AS width FROM b GROUP BY g, node")
def split_decomp(spark, sf_dir):
    h = inc.corpus(spark, sf_dir)
    placed = h.join(inc.positions(h), ["g", "e"]).withColumn("node", (F.col("pos") > 2).cast("int"))
    return placed.groupBy("g", "node").agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias("bag"), F.count_distinct("e").alias("width"))


@query(f"{_HM}, l AS (SELECT g, e, list(v ORDER BY v) AS vs FROM inc GROUP BY g, e), m AS (SELECT g, e, vs, unnest(range(0, 1 << len(vs))) AS m FROM l), t AS (SELECT g, e, m, list_filter(vs, lambda v, i: (m >> (i - 1)) & 1 = 1) AS s FROM m) SELECT g, e, array_to_string(s, ',') AS subset FROM t")
def edge_powerset(spark, sf_dir):
    lists = inc.edge_lists(inc.corpus(spark, sf_dir))
    return lists.select("g", "e", F.explode(sets.powerset(F.col("vertices"))).alias("x")).select("g", "e", F.array_join("x", ",").alias("subset"))


@query(
    f"{_HM}, {_POS}, conn AS (SELECT DISTINCT g, v FROM inc JOIN pos USING (g, e) WHERE p = 1), t AS (SELECT inc.* FROM inc SEMI JOIN conn USING (g, v)), ed AS (SELECT DISTINCT g, e FROM t),"
    " cand AS (SELECT g, e::VARCHAR AS s, e AS e1, e AS e2, 1 AS size FROM ed UNION ALL SELECT a.g, a.e || ',' || b.e, a.e, b.e, 2 FROM ed a JOIN ed b ON a.g = b.g AND a.e < b.e),"
    " h AS (SELECT c.g, c.s, c.size::BIGINT AS size, count(DISTINCT v) AS n FROM cand c JOIN t ON t.g = c.g AND t.e IN (c.e1, c.e2) GROUP BY ALL) SELECT h.g, s, size FROM h JOIN (SELECT g, count(*) AS w FROM conn GROUP BY g) USING (g) WHERE n = w"
)
def cover_enumeration(spark, sf_dir):
    h = inc.corpus(spark, sf_dir)
    return comp.covers(h, inc.separator_vertices(h, inc.lowest_edges(h, 1)))


@query(
    f"{_HM}, {_POS}, conn AS (SELECT DISTINCT g, v FROM inc JOIN pos USING (g, e) WHERE p <= 2), w AS (SELECT g, bit_or(1 << v) AS want FROM conn GROUP BY g),"
    " t AS (SELECT g, e, bit_or(1 << v) AS m, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, e) AS pl FROM inc SEMI JOIN conn USING (g, v) GROUP BY g, e),"
    " c1 AS (SELECT g, [e] AS es, m, pl FROM t), c2 AS (SELECT g, list_append(es, t.e) AS es, c.m | t.m AS m, t.pl FROM c1 c JOIN w USING (g) JOIN t USING (g) WHERE t.pl > c.pl AND c.m != want),"
    " c3 AS (SELECT g, list_append(es, t.e) AS es, c.m | t.m AS m, t.pl FROM c2 c JOIN w USING (g) JOIN t USING (g) WHERE t.pl > c.pl AND c.m != want)"
    " SELECT g, array_to_string(list_sort(es), ',') AS s, len(es) AS size FROM (FROM c1 UNION ALL FROM c2 UNION ALL FROM c3) JOIN w USING (g) WHERE m = want"
)
def ordered_covers(spark, sf_dir):
    """Covers of the two lowest edges' vertices by at most three edges, heaviest edges first, each stopping at the edge that completes it."""
    h = cut(inc.corpus(spark, sf_dir), "graphs")
    return comp.covers(h, inc.separator_vertices(h, inc.lowest_edges(h, 2)), 3, beyond=False)


@query(f"{_HM}, l AS (SELECT g, e, string_agg('V' || v, ', ' ORDER BY v) AS vs FROM inc GROUP BY g, e) SELECT g, string_agg('E' || e || ' (' || vs || ')', ',' || chr(10) ORDER BY e) || '.' AS text FROM l GROUP BY g")
def hyperbench_export(spark, sf_dir):
    return text_formats.to_hyperbench(inc.corpus(spark, sf_dir))


@query(
    f"{_HP}, {_POS}, f AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY min(e), v) AS n FROM inc GROUP BY g, v), l AS (SELECT g, p, string_agg(n, ' ' ORDER BY n) AS ns, max(n) AS top FROM inc JOIN pos USING (g, e) JOIN f USING (g, v) GROUP BY g, p)"
    " SELECT g, 'p htd ' || max(top) || ' ' || count(*) || chr(10) || string_agg(p || '  ' || ns, chr(10) ORDER BY p) || chr(10) AS text FROM l GROUP BY g"
)
def pace_export(spark, sf_dir):
    return text_formats.to_pace(inc.corpus(spark, sf_dir, "hp"))


@query(f"{_HM}, l AS (SELECT g, e, string_agg(v, ',' ORDER BY v) AS vertices FROM inc GROUP BY g, e) SELECT g, 'E' || e AS edge, vertices FROM l")
def hyperbench_roundtrip(spark, sf_dir):
    """Written and read again; labels V<id> back to ids."""
    texts = text_formats.to_hyperbench(inc.corpus(spark, sf_dir)).select(F.col("g").cast("string").alias("name"), "text")
    back = text_formats.labelled_edges(texts)
    return back.groupBy(F.col("name").cast("long").alias("g"), "edge").agg(F.array_join(F.array_sort(F.collect_set(F.expr("cast(substring(vertex, 2) as bigint)"))), ",").alias("vertices"))


def _outcome(found: DataFrame) -> DataFrame:
    """(g, verdict, width); the width is null where there is no tree."""
    return found.groupBy("g").agg(F.first("verdict").alias("verdict"), F.max(F.size("cover")).alias("width"))


def _solved(kind: str, k: int = 2):
    """What a solver says of width k: yes or no, of every graph."""

    def run(spark, sf_dir):
        return solvers.outcomes(inc.corpus(spark, sf_dir), k, kind)

    return run


for _kind in ("global", "local", "hybrid", "cost", "det"):
    QUERIES[f"solve_{_kind}_k2"] = _solved(_kind)


@query()
def exact_width(spark, sf_dir):
    return _outcome(solvers.search_graphs(inc.corpus(spark, sf_dir), "exact", kind="det"))


@query()
def approximate_width(spark, sf_dir):
    """Verdict 'open' marks graphs whose width may be lower still."""
    return _outcome(solvers.search_graphs(inc.corpus(spark, sf_dir), "approx", kind="det", steps=20_000))


@query()
def decomposition_valid(spark, sf_dir):
    """Graphs whose search stays open have a row too."""
    h = inc.corpus(spark, sf_dir)
    found = cut(solvers.search_graphs(h, "exact", kind="det"), "trees")
    checked = trees.validate(found.where("node IS NOT NULL").drop("verdict"), h)
    return found.select("g", "verdict").distinct().join(checked, "g", "left")


_HINGE = (
    "ed AS (SELECT DISTINCT g, e FROM inc), rest AS MATERIALIZED (SELECT x.g, x.e AS x, i.e, i.v FROM ed x JOIN inc i USING (g) ANTI JOIN inc s ON s.g = x.g AND s.e = x.e AND s.v = i.v),"
    " link AS MATERIALIZED (SELECT DISTINCT a.g, a.x, a.e, b.e AS f FROM rest a JOIN rest b USING (g, x, v)), reach AS (SELECT * FROM link UNION SELECT r.g, r.x, r.e, l.f FROM reach r JOIN link l ON l.g = r.g AND l.x = r.x AND l.e = r.f),"
    " lab AS MATERIALIZED (SELECT g, x, e, comp FROM (SELECT g, x, e, min(f) AS comp FROM reach GROUP BY ALL) QUALIFY min(comp) OVER (PARTITION BY g, x) != max(comp) OVER (PARTITION BY g, x)),"
    " st AS (SELECT g, -1::BIGINT AS px, -1::BIGINT AS pc, e, true AS own, 0 AS k FROM ed UNION ALL SELECT * FROM ("
    "WITH pl AS (SELECT a.g, a.px, a.pc, lab.x, lab.comp, count(*) AS n, bool_or(b.e = a.px) AS up FROM st a JOIN lab ON lab.g = a.g AND lab.x = a.e JOIN st b ON b.g = a.g AND b.px = a.px AND b.pc = a.pc AND b.e = lab.e GROUP BY ALL),"
    " sp AS (SELECT g, px, pc, x, max(n) AS n, coalesce(min(comp) FILTER (up), min(comp)) AS home FROM pl GROUP BY ALL HAVING count(*) > 1),"
    " pk AS (SELECT g, px, pc, arg_min(x, (n, x)) AS x, arg_min(home, (n, x)) AS home FROM sp GROUP BY ALL),"
    " mv AS (SELECT s.*, pk.x, pk.home, lab.comp FROM st s JOIN pk USING (g, px, pc) LEFT JOIN lab ON lab.g = s.g AND lab.x = pk.x AND lab.e = s.e)"
    " SELECT g, CASE WHEN comp != home THEN x ELSE px END AS px, CASE WHEN comp != home THEN comp ELSE pc END AS pc, e, own, k + 1 AS k FROM mv UNION ALL SELECT DISTINCT g, x, comp, x, false, k + 1 FROM mv WHERE comp != home)),"
    " fin AS (SELECT g, (dense_rank() OVER (PARTITION BY g ORDER BY px, pc) - 1)::INT AS part, px, e, own FROM (SELECT * FROM st QUALIFY k = max(k) OVER (PARTITION BY g, px, pc))),"
    " hi AS (SELECT a.g, a.part, b.part AS parent, nullif(a.px, -1) AS shared, a.e FROM fin a LEFT JOIN fin b ON b.g = a.g AND b.e = a.px AND b.own),"
    " big AS (SELECT g, arg_min(part, (-n, part)) AS part, max(n) AS edges FROM (SELECT g, part, count(*) AS n FROM hi GROUP BY g, part) GROUP BY g)"
)
_REDUCED = f"{_gyo_sql(_HM, 5)}, inc AS MATERIALIZED (SELECT * FROM i5)"


@query(f"{_REDUCED}, {_HINGE} SELECT * FROM hi")
def hinge_tree(spark, sf_dir):
    return hinges.hinge_tree(_reduced(spark, sf_dir))


# Distances of at most 9: these graphs have 10 vertices.
_REMOVED = (
    "ed AS (SELECT DISTINCT g, e FROM inc), rm AS (SELECT * FROM ed UNION ALL SELECT DISTINCT g, -1 FROM ed), ad AS MATERIALIZED (SELECT DISTINCT a.g, rm.e AS x, a.v AS a, b.v AS b FROM rm JOIN inc a USING (g) JOIN inc b ON b.g = a.g AND b.e = a.e AND b.v != a.v WHERE a.e != rm.e),"
    " wk AS (SELECT g, x, a, b, 1 AS dist FROM ad UNION SELECT w.g, w.x, w.a, d.b, dist + 1 FROM wk w JOIN ad d ON d.g = w.g AND d.x = w.x AND d.a = w.b WHERE dist < 9 AND d.b != w.a), sh AS (SELECT g, x, a, b, min(dist) AS dist FROM wk GROUP BY ALL),"
    " chg AS (SELECT o.g, ed.e, coalesce(sum(n.dist - o.dist), 0)::BIGINT AS stretched, (count(*) - count(n.dist))::BIGINT AS lost FROM ed JOIN sh o ON o.g = ed.g AND o.x = -1 LEFT JOIN sh n ON n.g = o.g AND n.x = ed.e AND n.a = o.a AND n.b = o.b GROUP BY o.g, ed.e)"
)


@query(f"{_REDUCED}, {_REMOVED} SELECT * FROM chg")
def distance_change(spark, sf_dir):
    return distances.distance_change(_reduced(spark, sf_dir))


@query(f"{_REDUCED}, {_REMOVED} SELECT g, e, row_number() OVER (PARTITION BY g ORDER BY lost DESC, stretched DESC, e)::INT AS rank FROM chg")
def max_separator_order(spark, sf_dir):
    return distances.max_separator_order(_reduced(spark, sf_dir))


@query(f"{_HS}, {_HINGE} SELECT * FROM hi")
def hinge_tree_sparse(spark, sf_dir):
    """Of whole graphs, which fall into more and deeper parts than reduced ones."""
    return hinges.hinge_tree(cut(inc.corpus(spark, sf_dir, "hs"), "graphs"))


@query(f"{_HS}, {_HINGE} SELECT big.g, edges::INT AS width, n AS nodes, true AS valid FROM big JOIN (SELECT g, count(DISTINCT part) AS n FROM hi GROUP BY g) USING (g)")
def hinge_grafted(spark, sf_dir):
    """A node for each part, grafted along the shared edges: valid trees as wide as the largest part."""
    h = cut(inc.corpus(spark, sf_dir, "hs"), "graphs")
    tree = cut(hinges.hinge_tree(h), "hinges")
    lists = hinges.part_graphs(tree, h).groupBy("g").agg(F.array_sort(F.collect_set("v")).alias("bag"), F.array_sort(F.collect_set("e")).alias("cover"))
    nodes = lists.select("g", F.lit(1).alias("node"), F.lit(None).cast("int").alias("parent"), "bag", "cover")
    whole = cut(hinges.graft(tree, cut(nodes, "part-trees"), h), "trees")
    return trees.validate(whole, h).join(whole.groupBy("g").agg(F.count("*").alias("nodes")), "g").select("g", "width", "nodes", "valid")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acyclicity, residual edges and the number of balanced separators of at most two edges, for each graph."""
    h = inc.corpus(spark, sf_dir)
    residue = reductions.gyo(h)
    count = comp.balanced_sets(residue, 2).groupBy("g").agg(F.count("*").alias("n"))
    return reductions.acyclic(h, residue).join(count, "g", "left").select("g", "is_acyclic", "residual_edges", F.coalesce("n", F.lit(0)).alias("separators"))
