import hashlib
import random
import zlib

import duckdb
import pytest

from hyperloom.llm import prefix_trie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, shared):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    if shared:
        heads = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
        convs = {c: convs.get(c - c % 5, [])[: heads[c]] + ts[heads[c] :] for c, ts in convs.items()}
    nodes = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        children = [s for s in below if len(s) == len(seq) + 1]
        leaves = [s for s in below if not any(len(t) == len(s) + 1 and t[: len(s)] == s for t in below)]
        saved = sum((len(nodes[s]) - 1) * len(s[-1][1].encode()) for s in below if s)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(seq))
        out.append((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shared", [False, True])
def test_equals_plain(spark, shared, monkeypatch):
    """Shared and repeated prefixes, nulls, ties, conversations of one to forty turns, gaps in ids and turns."""
    monkeypatch.setattr(prefix_trie, "STRIP", 4)
    rng, rows = random.Random(3), []
    for c in range(70):
        if c % 7 == 0:
            continue
        for t in range(rng.choice((1, 1, 2, 5, 8, 40))):
            rows.append((c, rng.choice((t, 3 * t, None)), rng.choice(("user", "a", None)) if rng.random() < 0.1 else "user", rng.choice(("é", "ab", None, "")) if rng.random() < 0.2 else f"t{t}"))
    rows += [(None, 0, "user", "t0"), (-3, 1, "user", "t0"), (-3, 1, "user", "t0"), (900, 0, None, None)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(prefix_trie.conversation_trie(table, shared)) == plain(rows, shared)


def test_one_long_conversation_and_empty_table(spark):
    """A conversation of many turns beside copies of its start; clashing extra columns; no rows."""
    rows = [(1, t, "user", "same") for t in range(300)] + [(2, t, "user", "same") for t in range(129)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "turn AS pos", "role AS name", "1 AS bytes", "2 AS conv", "3 AS d")
    assert got(prefix_trie.conversation_trie(table)) == plain(rows, False)
    assert got(prefix_trie.conversation_trie(table.limit(0), True)) == []


def test_names_are_dense(spark):
    names = prefix_trie.dense_names(spark.range(1000).selectExpr("id % 37 AS a", "id % 2 AS b").repartition(6), ["a", "b"], "t").collect()
    assert sorted(r["name"] for r in names) == list(range(1, 75))


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    cur = con.execute(queries.ORACLES["op11_prefix_trie"])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in cur.fetchall()), key=str)
    found = queries.QUERIES["op11_prefix_trie"](spark, sf)
    assert sorted(names) == sorted(found.columns) and got(found) == want
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert want == plain(rows, True)
