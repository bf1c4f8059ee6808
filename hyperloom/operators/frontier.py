"""Search for balanced separators, and decompositions by them, spread over all graphs, subproblems and candidates at once.

A subproblem (g, key, edges, specials) is a row: edges as array<struct<e, vs>>, specials (vertex sets of separators chosen above, carried as one unit) as sorted arrays; its key is its
content, so that equal subproblems of a graph are one row, wherever they arise. Candidates are ranks: the sets of ``k`` of its n parts in colexicographic order, then those of k - 1, down
to single ones. A rank becomes a set, and the set's components become sizes, by expressions alone; nothing is exchanged for a candidate. Blocks of ranks of rising size are
tested, large blocks dealt out in chunks over the cluster, and a subproblem stops at its first block with a hit, of which the smallest rank counts.

``solve`` is a search over and/or levels: every open subproblem takes the different balanced separators of its next block of ranks, the components become new rows unless their key is known
(solved, failed or open), and verdicts flow back: all parts solved solves, a failed part ends its separator. A subproblem left without one goes on with a larger block, and fails where
there is none, so that going back costs a round for a block and not for a candidate. Balanced parts hold at most half of a subproblem and one special,
so chains of parts are as short as the logarithm of the edges.

A graph's edges are an array in a row, and a candidate reads it whole; graphs, subproblems and chunks of candidates are what spreads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.functions.sets import choose
from hyperloom.operators import packed, small_search
from hyperloom.operators.incidence import edge_lists
from hyperloom.storage import cut

EDGES = "array<struct<e:bigint,vs:array<bigint>>>"
#: Candidates of a first block, growth from block to block, and candidates of a chunk of a large block.
FIRST, GROWTH, CHUNK = 64, 32, 1024
#: Marks a subproblem whose ranks have all been looked at.
_LAST = 1_000
#: Largest part whose subsets are listed.
MOST_ARITY = 12


def graph_rows(inc: DataFrame) -> DataFrame:
    """(g, edges), by edge id."""
    lists = edge_lists(inc).select("g", F.struct(F.col("e").cast("long").alias("e"), F.array_sort("vertices").alias("vs")).alias("x"))
    return lists.groupBy("g").agg(F.array_sort(F.collect_list("x")).cast(EDGES).alias("edges"))


def with_key(problems: DataFrame) -> DataFrame:
    """Key of (edges, specials), both in order."""
    specials = F.expr("array_join(transform(specials, s -> array_join(s, ',')), ';')")
    return problems.withColumn("key", F.concat(F.array_join(F.col("edges.e"), ","), F.lit("|"), specials))


def whole_graphs(inc: DataFrame) -> DataFrame:
    """Each graph as one subproblem with all its edges as parts, from the first rank on."""
    rows = with_key(graph_rows(inc).withColumn("specials", F.expr("CAST(array() AS array<array<bigint>>)")))
    return rows.withColumn("parts", F.col("edges")).withColumn("cursor", F.lit(0).cast("long"))


def parts_of(edges: str, specials: str, separator: str) -> Column:
    """Components as array<struct<es, ss, rest>>: edge ids, specials and vertices outside the separator, by folding one edge or special after the other into those that it touches.

    Edges inside the separator are in none, each special inside it is one of its own.
    """
    return F.expr(
        f"""aggregate(
          concat(
            filter(transform({edges}, x -> struct(array(x.e) AS es, CAST(array() AS array<array<bigint>>) AS ss, array_except(x.vs, {separator}) AS rest)), x -> size(x.rest) > 0),
            transform({specials}, s -> struct(CAST(array() AS array<bigint>) AS es, array(s) AS ss, array_except(s, {separator}) AS rest))),
          CAST(array() AS array<struct<es:array<bigint>,ss:array<array<bigint>>,rest:array<bigint>>>),
          (acc, x) -> concat(
            filter(acc, c -> NOT arrays_overlap(c.rest, x.rest)),
            array(struct(
              concat(flatten(transform(filter(acc, c -> arrays_overlap(c.rest, x.rest)), c -> c.es)), x.es) AS es,
              concat(flatten(transform(filter(acc, c -> arrays_overlap(c.rest, x.rest)), c -> c.ss)), x.ss) AS ss,
              array_distinct(concat(flatten(transform(filter(acc, c -> arrays_overlap(c.rest, x.rest)), c -> c.rest)), x.rest)) AS rest))))"""
    )


def candidate_count(n: Column, k: int) -> Column:
    return sum((choose(n, m) for m in range(k, 1, -1)), choose(n, 1))


def _largest(n: Column, j: int, most: Column) -> Column:
    """The largest position from 0 with at most ``most`` sets of j below it."""
    return F.array_max(F.filter(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda c: choose(c, j) <= most))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _places(left: Column, n: Column, j: int) -> Column:
    """Positions from 0 of the set of j of rank ``left``; the last to find is what remains itself."""
    if j == 1:
        return F.array(left)
    return _let(_largest(n, j, left), lambda at: F.array_append(_places(left - choose(at, j), n, j - 1), at))


def unrank(rank: Column, n: Column, k: int) -> Column:
    """Positions from 0 of the candidate of a rank: all sets of k in colexicographic order, then of k - 1, down to 1."""
    found = F.expr("CAST(NULL AS array<bigint>)")
    for m in range(1, k + 1):
        before = sum((choose(n, j) for j in range(k, m, -1)), F.lit(0).cast("long"))
        found = F.when((rank >= before) & (rank < before + choose(n, m)), _places(rank - before, n, m)).otherwise(found)
    return found


def cut_parts(problems: DataFrame, graphs: DataFrame, subedges: bool = False) -> DataFrame:
    """``problems`` with ``parts``: the graph's edges cut to the subproblem's vertices, of equal ones the first; with ``subedges`` all subsets of these."""
    inside = "array_distinct(concat(flatten(edges.vs), flatten(specials)))"
    joined = problems.join(graphs.select("g", F.col("edges").alias("whole")), "g").withColumn("inside", F.expr(inside))
    cuts = joined.withColumn("cuts", F.expr("filter(transform(whole, x -> struct(x.e AS e, array_sort(array_intersect(x.vs, inside)) AS vs)), x -> size(x.vs) > 0)"))
    if subedges:
        grow = "aggregate(x.vs, CAST(array(array()) AS array<array<bigint>>), (acc, v) -> concat(acc, transform(acc, s -> array_append(s, v))))"
        checked = f"CASE WHEN size(x.vs) > {MOST_ARITY} THEN raise_error('an edge has more vertices than subsets are listed of') ELSE {grow} END"
        cuts = cuts.withColumn("cuts", F.expr(f"filter(flatten(transform(cuts, x -> transform({checked}, s -> struct(x.e AS e, s AS vs)))), x -> size(x.vs) > 0)"))
        # Large parts first.
        cuts = cuts.withColumn("cuts", F.expr("array_sort(cuts, (a, b) -> CASE WHEN size(a.vs) != size(b.vs) THEN size(b.vs) - size(a.vs) WHEN a.e < b.e THEN -1 WHEN a.e > b.e THEN 1 ELSE 0 END)"))
    firsts = "transform(filter(transform(array_distinct(cuts.vs), v -> array_position(cuts.vs, v)), p -> p > 0), p -> cuts[int(p) - 1])"
    return cuts.withColumn("parts", F.expr(firsts)).drop("whole", "inside", "cuts")


def separator_of(k: int, rank: Column) -> tuple[Column, Column]:
    """Vertices and edge ids of the candidate ``rank`` of ``parts``."""
    chosen = F.transform(unrank(rank, F.size("parts"), k), lambda p: F.get(F.col("parts"), p.cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(chosen, lambda x: x["vs"])))), F.array_distinct(F.transform(chosen, lambda x: x["e"]))


def balanced_blocks(problems: DataFrame, k: int, factor: int = 2) -> DataFrame:
    """(g, key, end, tested, hits) of (g, key, edges, specials, parts, cursor, attempt): for each subproblem the first block of ranks from the cursor on with a separator that leaves no part above
    floor(size * (factor - 1) / factor) and is no special. ``hits`` are the different ones (rank, separator) of this block, null where no block has any; ``end`` is where it ends, and
    ``tested`` counts the candidates of all blocks looked at. Blocks grow, and start larger at a later attempt."""
    size = F.least(F.lit(FIRST).cast("long") * F.pow(F.lit(GROWTH), F.col("attempt")).cast("long"), F.lit(1 << 40))
    open_ = problems.withColumn("until", candidate_count(F.size("parts"), k)).withColumn("low", F.col("cursor")).withColumn("block", size)
    done = None
    while True:
        end = F.least(F.col("low") + F.col("block"), F.col("until"))
        starts = open_.where("low < until").withColumn("start", F.explode(F.sequence("low", end - 1, F.lit(CHUNK).cast("long")))).withColumn("end", end)
        if done is not None:
            starts = starts.repartition("g", "key", "start")
        # Separators come out of the explosion, as a condition on columns would be moved below them and work them out again for each part; the outer form adds no condition of its own.
        chunk = F.sequence("start", F.least(F.col("start") + CHUNK, F.col("end")) - 1)
        ranks = starts.withColumn("x", F.explode_outer(F.transform(chunk, lambda r: F.struct(r.alias("rank"), separator_of(k, r)[0].alias("separator"))))).select("*", "x.rank", "x.separator").drop("x")
        tried = ranks.withColumn("sizes", F.transform(parts_of("edges", "specials", "separator"), lambda c: F.size(c["es"]) + F.size(c["ss"])))
        limit = F.expr(f"(size(edges) + size(specials)) * {factor - 1} DIV {factor}")
        fit = tried.where((F.coalesce(F.array_max("sizes"), F.lit(0)) <= limit) & ~F.array_contains("specials", F.col("separator")))
        hits = fit.groupBy("g", "key", "separator").agg(F.min("rank").alias("rank")).groupBy("g", "key").agg(F.collect_list(F.struct("rank", "separator")).alias("hits"))
        found = open_.join(hits, ["g", "key"], "left").withColumn("end", F.greatest(end, F.col("cursor"))).withColumn("more", F.col("hits").isNull() & (end < F.col("until")))
        found = cut(found.withColumn("tested", F.col("end") - F.col("cursor")), "rank-hits")
        step = found.where("NOT more").select("g", "key", "end", "tested", "hits")
        done = step if done is None else done.union(step)
        if found.where("more").isEmpty():
            return done
        open_ = found.where("more").withColumn("low", F.col("end")).withColumn("block", F.col("block") * GROWTH).drop("end", "tested", "more", "hits")


def first_balanced(problems: DataFrame, k: int, factor: int = 2) -> DataFrame:
    """(g, key, rank, tested): the smallest rank of a balanced separator of each subproblem, null where there is none, and the candidates tested for it."""
    found = balanced_blocks(problems.withColumn("attempt", F.lit(0)), k, factor)
    return found.select("g", "key", F.array_min(F.transform("hits", lambda x: x["rank"])).alias("rank"), "tested")


def _based(k: int) -> Column:
    return F.expr(f"size(edges) + size(specials) <= 2 OR (size(edges) <= {k} AND size(specials) <= 1)")


def solve(inc: DataFrame, k: int, subedges: bool = False, waves: int = 1_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdicts (g, verdict, subproblems), the solved subproblems (g, key, edges, specials, separator, cover, kids), and the roots (g, key).

    'yes' has a tree of width k or less. With ``subedges`` separators are all subsets of unions of k edges, and 'no' says that there is no such tree; without, 'no' says that
    there is none whose separators are whole edges within their subproblem. 'open' marks graphs undecided after ``waves``.
    """
    graphs = cut(graph_rows(inc), "graphs")
    start = with_key(graphs.withColumn("specials", F.expr("CAST(array() AS array<array<bigint>>)")))
    fields = "g", "key", "edges", "specials", "cursor", "attempt", "status"
    new_state = F.lit(0).cast("long").alias("cursor"), F.lit(0).alias("attempt"), F.when(_based(k), "yes").otherwise("open").alias("status")
    known = cut(start.select("g", "key", "edges", "specials", *new_state), "subproblems")
    roots = cut(known.select("g", "key"), "roots")
    active, solved = None, []
    for _ in range(waves):
        open_roots = known.join(roots, ["g", "key"], "left_semi").where("status = 'open'").select("g")
        idle = known.where("status = 'open'").join(open_roots, "g", "left_semi")
        if active is not None:
            wanted = active.select("g", F.explode("kids").alias("key")).union(roots).distinct()
            idle = idle.join(active, ["g", "key"], "left_anti").join(wanted, ["g", "key"], "left_semi")
        idle = cut(cut_parts(idle, graphs, subedges), "idle")
        if not idle.isEmpty():
            blocks = balanced_blocks(idle, k)
            hits = idle.join(blocks.where("hits IS NOT NULL"), ["g", "key"])
            chosen = hits.withColumn("hit", F.explode("hits")).select("*", "hit.rank", "hit.separator").drop("hit", "hits")
            found = chosen.withColumn("cover", separator_of(k, F.col("rank"))[1])
            pieces = found.withColumn("pieces", parts_of("edges", "specials", "separator")).select("g", "key", "rank", "separator", "cover", "edges", F.explode_outer("pieces").alias("piece"))
            own = pieces.withColumn("edges", F.expr("filter(edges, x -> array_contains(piece.es, x.e))")).withColumnRenamed("key", "above")
            own = own.withColumn("specials", F.expr("array_sort(array_distinct(array_append(piece.ss, separator)))"))
            own = cut(with_key(own).withColumn("key", F.when(F.col("piece").isNotNull(), F.col("key"))), "pieces")
            fresh = own.groupBy("g", F.col("above").alias("key"), "rank").agg(F.min("separator").alias("separator"), F.min("cover").alias("cover"), F.array_sort(F.collect_list("key")).alias("kids"))
            # Every subproblem met before, failed or not, is not searched again.
            new = own.where("key IS NOT NULL").select("g", "key", "edges", "specials").dropDuplicates(["g", "key"]).join(known, ["g", "key"], "left_anti")
            moved = blocks.join(idle.select("g", "key", F.size("parts").alias("n")), ["g", "key"]).select(
                "g", "key", F.col("hits").isNull().alias("failed"), F.col("end").alias("next"), (F.col("end") >= candidate_count(F.col("n"), k)).alias("last")
            )
            after = known.join(moved, ["g", "key"], "left").select(
                "g", "key", "edges", "specials", F.coalesce("next", "cursor").alias("cursor"), F.when(F.col("last"), _LAST).otherwise(F.col("attempt") + F.col("next").isNotNull().cast("int")).alias("attempt"),
                F.when(F.col("failed"), "no").otherwise(F.col("status")).alias("status"),
            )
            known = cut(after.union(new.select("g", "key", "edges", "specials", *new_state)), "subproblems")
            active = cut(fresh if active is None else active.unionByName(fresh), "active")
        if active is None:
            break
        # Verdicts of the parts flow to the subproblems above them, as far as they reach.
        while True:
            states = active.select("g", "key", "rank", F.explode_outer("kids").alias("kid")).join(known.select("g", F.col("key").alias("kid"), "status"), ["g", "kid"], "left")
            states = states.groupBy("g", "key", "rank").agg(F.min(F.when(F.col("kid").isNull(), True).otherwise(F.col("status") == "yes")).alias("good"), F.max(F.coalesce(F.col("status") == "no", F.lit(False))).alias("bad"))
            states = cut(states.where("good OR bad"), "states")
            if states.isEmpty():
                break
            wins = states.where("good").groupBy("g", "key").agg(F.min("rank").alias("rank"))
            solved.append(cut(active.join(wins, ["g", "key", "rank"], "left_semi"), "solved"))
            yes = wins.select("g", "key", F.lit(True).alias("won"))
            active = cut(active.join(states, ["g", "key", "rank"], "left_anti").join(wins, ["g", "key"], "left_anti"), "active")
            live = active.select("g", "key", F.lit(True).alias("live")).distinct()
            lost = (F.col("status") == "open") & (F.col("attempt") == _LAST) & F.col("live").isNull()
            told = known.join(yes, ["g", "key"], "left").join(live, ["g", "key"], "left")
            known = cut(told.withColumn("status", F.when(F.col("won"), "yes").when(lost, "no").otherwise(F.col("status"))).select(*fields), "subproblems")
        if known.join(roots, ["g", "key"], "left_semi").where("status = 'open'").isEmpty():
            break
    sizes = known.groupBy("g").agg(F.count("*").alias("subproblems"))
    verdicts = known.join(roots, ["g", "key"], "left_semi").select("g", F.col("status").alias("verdict")).join(sizes, "g")
    none = "CAST(NULL AS bigint) AS rank", "CAST(NULL AS array<bigint>) AS separator", "CAST(NULL AS array<bigint>) AS cover", "CAST(NULL AS array<string>) AS kids"
    choices = known.where("status = 'yes'").where(_based(k)).selectExpr("g", "key", *none)
    for frame in solved:
        choices = choices.union(frame.select("g", "key", "rank", "separator", "cover", "kids"))
    choices = known.select("g", "key", "edges", "specials").join(choices.drop("rank"), ["g", "key"])
    return verdicts, choices, roots


def trees_of(verdicts: DataFrame, choices: DataFrame, roots: DataFrame, k: int) -> DataFrame:
    """(g, node, parent, bag, cover) of the graphs with verdict 'yes'.

    Subproblems unfold level by level into occurrences, each special knowing the node that it came from. A separator is a node; a smallest subproblem is a node of its edges, linked to the nodes of
    its specials, or a link between those alone. The links, undirected so far, get their direction from the root outwards.
    """
    choices = cut(choices, "choices")
    here = roots.join(verdicts.where("verdict = 'yes'"), "g", "left_semi").select("g", F.lit("0").alias("occ"), "key", F.expr("CAST(array() AS array<struct<vs:array<bigint>,owner:string>>)").alias("owners"))
    nodes, links = [], []
    while True:
        at = cut(here.join(choices, ["g", "key"]), "unfolded")
        inner, base = at.where("separator IS NOT NULL"), at.where("separator IS NULL")
        nodes.append(inner.select("g", F.col("occ").alias("name"), F.col("separator").alias("bag"), "cover"))
        if k == 1:
            # Two edges do not fit one node: a node for each, the second beside the first.
            second = base.where("size(edges) = 2")
            nodes.append(second.selectExpr("g", "concat(occ, 'b') AS name", "edges[1].vs AS bag", "array(edges[1].e) AS cover"))
            links.append(second.selectExpr("g", "occ AS x", "concat(occ, 'b') AS y"))
        held = F.slice("edges", 1, k)
        nodes.append(base.where("size(edges) > 0").select("g", F.col("occ").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.transform(held, lambda x: x["vs"])))).alias("bag"), F.transform(held, lambda x: x["e"]).alias("cover")))
        links.append(base.where("size(edges) > 0").select("g", F.col("occ").alias("x"), F.explode("owners.owner").alias("y")))
        links.append(base.where("size(edges) = 0 AND size(owners) = 2").selectExpr("g", "owners[0].owner AS x", "owners[1].owner AS y"))
        if inner.isEmpty():
            break
        kids = inner.select("g", "occ", "separator", "owners", F.posexplode("kids").alias("n", "key")).join(choices.select("g", "key", F.col("specials").alias("of_kid")), ["g", "key"])
        here = kids.selectExpr("g", "concat(occ, '.', n) AS occ", "key", "filter(array_append(owners, struct(separator AS vs, occ AS owner)), o -> array_contains(of_kid, o.vs)) AS owners")
    every = nodes[0]
    for frame in nodes[1:]:
        every = every.union(frame)
    pairs = links[0]
    for frame in links[1:]:
        pairs = pairs.union(frame)
    every, pairs = cut(every, "tree-nodes"), cut(pairs, "tree-links")
    both = pairs.union(pairs.select("g", F.col("y").alias("x"), F.col("x").alias("y")))
    reached = cut(every.where("name = '0'").select("g", "name", F.lit(None).cast("string").alias("up")), "tree-reached")
    edge = reached
    while not edge.isEmpty():
        step = edge.select("g", F.col("name").alias("x")).join(both, ["g", "x"]).select("g", F.col("y").alias("name"), F.col("x").alias("up"))
        edge = cut(step.join(reached, ["g", "name"], "left_anti"), "tree-edge")
        reached = cut(reached.union(edge), "tree-reached")
    ids = cut(every.select("g", "name", F.expr("CAST(row_number() OVER (PARTITION BY g ORDER BY name) AS INT)").alias("node")), "tree-ids")
    placed = every.join(reached, ["g", "name"]).join(ids, ["g", "name"]).join(ids.select("g", F.col("name").alias("up"), F.col("node").alias("parent")), ["g", "up"], "left")
    return placed.select("g", "node", "parent", "bag", "cover")


def decompose(inc: DataFrame, k: int, waves: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """The verdicts of ``solve`` and the trees of ``trees_of``, by separators of whole edges. Small graphs are searched as rows (``packed``), by the same waves and ranks."""
    fields = "verdict string, subproblems long, node int, parent int, bag array<bigint>, cover array<bigint>"
    found = cut(packed.over_graphs(inc, small_search.search_rows(k, FIRST, GROWTH, 1 << 40, waves), fields, lambda rows: _decompose_by_joins(rows, k, waves), packed.MOST_TRIED), "decomposed")
    return found.select("g", "verdict", "subproblems").distinct(), found.where("node IS NOT NULL").select("g", "node", "parent", "bag", "cover")


def _decompose_by_joins(inc: DataFrame, k: int, waves: int) -> DataFrame:
    verdicts, choices, roots = solve(inc, k, waves=waves)
    verdicts = cut(verdicts, "verdicts")
    return verdicts.join(trees_of(verdicts, choices, roots, k), "g", "left")
