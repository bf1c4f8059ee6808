"""Hypergraphs and decomposition trees as text: one file, or one row, for each graph.

Readers take (name, text) rows, so a folder of files is one ``spark.read.text(..., wholetext=True)``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperloom.operators import packed
from hyperloom.storage import cut

TOKEN = re.compile(r'"[^"]*"|[^\s(),.%"][^\s(),"]*|[(),.]')
LABELLED = "name string, edge string, edge_pos int, pos int, vertex string"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))


def parse_hyperbench(text: str) -> list[tuple[str, list[str]]]:
    """Edges ``Name(v1, v2, ...)``; comments run from % or // to the line's end; commas and the final stop are optional."""
    lines = [re.sub(r"%.*|//.*", "", line) for line in text.split("\n")]
    tokens = [t.rstrip(".") if t not in "(),." else t for t in TOKEN.findall("\n".join(lines))]
    edges, k = [], 0
    while k < len(tokens):
        if tokens[k] in (",", ".", ""):
            k += 1
            continue
        name = tokens[k].strip('"')
        if k + 1 >= len(tokens) or tokens[k + 1] != "(":
            raise ValueError(f"edge {name} without vertices")
        k += 2
        vertices = []
        while k < len(tokens) and tokens[k] != ")":
            if tokens[k] not in (",", ""):
                vertices.append(tokens[k].strip('"'))
            k += 1
        if k >= len(tokens):
            raise ValueError(f"edge {name} is not closed")
        k += 1
        edges.append((name, vertices))
    names = [n for n, _ in edges]
    labels = {v for _, vs in edges for v in vs}
    if len(set(names)) < len(names) or labels & set(names):
        raise ValueError("an edge name repeats or equals a vertex")
    return edges


def parse_pace(text: str) -> list[tuple[str, list[str]]]:
    """``p htd V E``, then ``edge v1 v2 ...``; comments start with c or //."""
    rows = [line.split() for line in text.split("\n") if line.strip() and not line.startswith(("c", "//"))]
    if not rows or rows[0][:2] != ["p", "htd"]:
        raise ValueError("no header 'p htd'")
    return [(f"E{r[0]}", [f"V{v}" for v in r[1:]]) for r in rows[1:]]


PARSERS = {"hyperbench": parse_hyperbench, "pace": parse_pace}


def labelled_edges(texts: DataFrame, kind: str = "hyperbench") -> DataFrame:
    """(name, edge, edge_pos, pos, vertex) of (name, text) rows; repeated vertices of an edge are kept."""
    parse = PARSERS[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(
                [(n, e, i, j, v) for n, t in zip(frame["name"], frame["text"], strict=True) for i, (e, vs) in enumerate(parse(t)) for j, v in enumerate(vs)],
                columns=["name", "edge", "edge_pos", "pos", "vertex"],
            )

    return texts.select("name", "text").mapInPandas(run, LABELLED)


def add_edges(labelled: DataFrame, texts: DataFrame, kind: str = "hyperbench") -> DataFrame:
    """``labelled`` with the edges of further texts (name, text) after its own; the dictionary over both gives their new labels ids."""
    last = labelled.groupBy("name").agg((F.max("edge_pos") + 1).alias("more"))
    new = labelled_edges(texts, kind).join(last, "name", "left").withColumn("edge_pos", F.col("edge_pos") + F.coalesce("more", F.lit(0)))
    return labelled.union(new.select(labelled.columns))


def transparent(labelled: DataFrame) -> DataFrame:
    """(name, e, v) where labels keep the number they end in as their id, instead of the dictionary's."""
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    return labelled.select("name", number("edge").alias("e"), number("vertex").alias("v")).distinct()


def dictionary(labelled: DataFrame) -> DataFrame:
    """(name, id, label, kind): vertices numbered from 1 by first appearance, edges after them."""
    first = labelled.groupBy("name", F.col("vertex").alias("label")).agg(F.min(F.struct("edge_pos", "pos")).alias("at")).withColumn("kind", F.lit("V"))
    edges = labelled.groupBy("name", F.col("edge").alias("label")).agg(F.min(F.struct("edge_pos", "pos")).alias("at")).withColumn("kind", F.lit("E"))
    order = Window.partitionBy("name").orderBy(F.desc("kind"), "at")
    return first.union(edges).select("name", F.row_number().over(order).cast("long").alias("id"), "label", "kind")


def encode(labelled: DataFrame, names: DataFrame) -> DataFrame:
    """(name, e, v) by the dictionary."""
    ids = lambda kind, column, out: names.where(F.col("kind") == kind).select("name", F.col("label").alias(column), F.col("id").alias(out))
    return labelled.join(ids("V", "vertex", "v"), ["name", "vertex"]).join(ids("E", "edge", "e"), ["name", "edge"]).select("name", "e", "v").distinct()


def to_hyperbench(inc: DataFrame) -> DataFrame:
    """(g, text): ``E<id> (V<id>, ...)`` lines."""
    edges = inc.groupBy("g", "e").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    line = F.concat(F.lit("E"), "e", F.lit(" ("), F.array_join(F.transform("vs", lambda v: F.concat(F.lit("V"), v.cast("string"))), ", "), F.lit(")"))
    lists = edges.select("g", F.struct("e", line.alias("line")).alias("x")).groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lists.select("g", F.concat(F.array_join("xs.line", ",\n"), F.lit(".")).alias("text"))


def to_pace(inc: DataFrame) -> DataFrame:
    """(g, text): vertices renumbered by first appearance, edges by order."""
    edge_no = Window.partitionBy("g").orderBy("e")
    edges = inc.select("g", "e").distinct().withColumn("i", F.row_number().over(edge_no))
    first = inc.groupBy("g", "v").agg(F.min("e").alias("at"))
    vertices = first.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("at", "v")))
    lists = inc.select("g", "e", "v").distinct().join(vertices.select("g", "v", "n"), ["g", "v"]).join(edges, ["g", "e"]).groupBy("g", "i").agg(F.array_sort(F.collect_list("n")).alias("ns"), F.max("n").alias("top"))
    line = F.concat(F.col("i").cast("string"), F.lit("  "), F.array_join("ns", " "))
    whole = lists.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("xs"), F.max("top").alias("v"))
    return whole.select("g", F.concat(F.lit("p htd "), F.col("v").cast("string"), F.lit(" "), F.size("xs").cast("string"), F.lit("\n"), F.array_join("xs.line", "\n"), F.lit("\n")).alias("text"))


def read_costs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(name, s, cost) from ragged rows ``edge_1,...,edge_n,cost`` of (name, text); s is the sorted edge ids joined by commas.

    Unknown edges, bad costs and repeated combinations are errors.
    """
    rows = texts.select("name", F.posexplode(F.split("text", "\n")).alias("r", "line")).where(F.trim("line") != "")
    cells = rows.select("name", "r", F.transform(F.split("line", ","), lambda x: F.trim(x)).alias("c"))
    cells = cells.withColumn("c", F.when(F.size("c") < 2, F.raise_error(F.concat(F.lit("a cost without an edge: "), F.col("c")[0])).cast("array<string>")).otherwise(F.col("c")))
    ids = names.where("kind = 'E'").select("name", F.col("label").alias("edge"), "id")
    picked = cells.select("name", "r", F.element_at("c", -1).cast("double").alias("cost"), F.explode(F.slice("c", 1, F.size("c") - 1)).alias("edge")).join(ids, ["name", "edge"], "left")
    known = picked.withColumn("id", F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("unknown edge "), "edge")).cast("long")).otherwise(F.col("id")))
    costs = known.groupBy("name", "r").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("s"), F.first("cost").alias("cost"))
    once = costs.groupBy("name", "s").agg(F.first("cost").alias("cost"), F.count("*").alias("n"))
    return once.select("name", "s", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two costs for "), "s")).cast("double")).otherwise(F.col("cost")).alias("cost"))


# --- trees ---


def tree_json(tree: DataFrame) -> DataFrame:
    """(g, json): nested nodes {"Bag", "Cover", "Children"} under "Root"; a leaf's children are null."""

    def small(rows: list[tuple]) -> Iterator[tuple[str]]:
        made = {node: {"Bag": [str(x) for x in bag], "Cover": [str(x) for x in cover], "Children": None} for node, _, bag, cover in rows}
        root = None
        for node, parent, _, _ in sorted(rows, key=lambda r: r[0]):
            if parent is None:
                root = made[node]
            else:
                above = made[parent]
                above["Children"] = [*(above["Children"] or []), made[node]]
        yield (json.dumps({"Root": root}),)

    return packed.together({"tree": tree.select("g", "node", "parent", "bag", "cover")}, small, "json string", None)


def _with_ids(tree: DataFrame, names: DataFrame | None) -> DataFrame:
    """Bags and covers of labels to ids: by ``names`` (g, id, label, kind), or else as whole numbers. A label that is neither is an error."""
    if names is None:
        ids = lambda c: F.transform(c, lambda x: x.cast("long"))
        return tree.select("g", "node", "parent", ids("bag").alias("bag"), ids("cover").alias("cover"))
    # A tree is bound to one graph, and so is its dictionary.
    entries = lambda kind, name: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("label", "id")))).alias(name)
    maps = names.groupBy("g").agg(entries("V", "of_v"), entries("E", "of_e"))
    unknown = lambda x: F.raise_error(F.concat(F.lit("no such label: "), x)).cast("long")
    ids = lambda c, m: F.transform(c, lambda x: F.coalesce(F.try_element_at(m, x), unknown(x)))
    return tree.join(maps, "g").select("g", "node", "parent", ids("bag", F.col("of_v")).alias("bag"), ids("cover", F.col("of_e")).alias("cover"))


def tree_from_json(texts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(g, node, parent, bag, cover) of (g, json); labels become ids by ``names`` (g, id, label, kind) where it is given."""

    columns, types = ["g", "node", "parent", "bag", "cover"], [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count, todo = 0, [(json.loads(text)["Root"], None)]
                while todo:
                    node, parent = todo.pop()
                    out.append((g, count, parent, [str(x) for x in node["Bag"] or []], [str(x) for x in node["Cover"] or []]))
                    todo += [(c, count) for c in node["Children"] or []]
                    count += 1
                if len(out) >= packed.BATCH:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=columns)

    return _with_ids(texts.select(F.col("g").cast("long").alias("g"), "json").mapInArrow(run, "g long, node int, parent int, bag array<string>, cover array<string>"), names)


def tree_gml(tree: DataFrame) -> DataFrame:
    """(g, gml): numbered nodes labelled {cover}{bag} and links from parents to children."""
    # One shuffle of the nodes' values, in partitions that grow in number with the rows; texts are made after it.
    rows = cut(tree.select("g", F.struct("node", "parent", "bag", "cover").alias("n")), "tree-nodes")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // packed.TASK_ROWS)
    lists = rows.repartition(tasks, "g").groupBy("g").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    label = lambda n: F.concat(F.lit("{"), F.array_join(n["cover"], ", "), F.lit("}{"), F.array_join(n["bag"], ", "), F.lit("}"))
    nodes = F.transform("ns", lambda n: F.concat(F.lit("  node [\n    id "), n["node"], F.lit('\n    label "'), label(n), F.lit('"\n  ]\n')))
    links = F.transform(F.filter("ns", lambda n: n["parent"].isNotNull()), lambda n: F.concat(F.lit("  edge [\n    source "), n["parent"], F.lit("\n    target "), n["node"], F.lit("\n  ]\n")))
    return lists.select("g", F.concat(F.lit("graph [\n  directed 0\n"), F.array_join(nodes, ""), F.array_join(links, ""), F.lit("]\n")).alias("gml"))


def tree_from_gml(texts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(g, node, parent, bag, cover) of (g, gml), whatever the order of nodes, links and their fields; labels become ids by ``names`` (g, id, label, kind) where it is
    given. A node without a number, or whose label is not {cover}{bag}, and a link without both ends are errors."""
    blocks = lambda word: F.regexp_extract_all("gml", F.lit(rf'\b{word}\s*\[((?:[^\]"]|"[^"]*")*)\]'), F.lit(1))
    # Quoted text goes before numbers are looked for.
    number = lambda field: F.regexp_extract(F.regexp_replace("x", '"[^"]*"', ""), rf"\b{field}\s+(\d+)", 1)
    need = lambda found, what: F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit(f"{what} missing in: "), F.col("x"))))
    label, shape = F.regexp_extract("x", r'\blabel\s+"([^"]*)"', 1), r"^\s*\{([^}]*)\}\s*\{([^}]*)\}\s*$"
    fits = F.when(label.rlike(shape), label).otherwise(F.raise_error(F.concat(F.lit("no {cover}{bag} label in: "), F.col("x"))))
    items = lambda k: F.filter(F.transform(F.split(F.regexp_extract(fits, shape, k), ","), lambda x: F.trim(x)), lambda x: x != "")
    nodes = texts.select("g", F.explode(blocks("node")).alias("x")).select("g", need(number("id"), "id").cast("int").alias("node"), items(2).alias("bag"), items(1).alias("cover"))
    links = texts.select("g", F.explode(blocks("edge")).alias("x")).select("g", need(number("target"), "target").cast("int").alias("node"), need(number("source"), "source").cast("int").alias("parent"))
    return _with_ids(nodes.join(links, ["g", "node"], "left").select("g", "node", "parent", "bag", "cover"), names)


def tree_lines(tree: DataFrame) -> DataFrame:
    """(g, node, text): a line for each node, indented by its depth."""
    from hyperloom.operators.trees import intervals

    depth = intervals(tree).select("g", "node", "depth")
    text = F.concat(F.repeat(F.lit("\t"), F.col("depth")), F.lit("Bag: {"), F.array_join("bag", ", "), F.lit("} Cover: {"), F.array_join("cover", ", "), F.lit("}"))
    return tree.join(depth, ["g", "node"]).select("g", "node", text.alias("text"))
