"""The trie of conversation prefixes, named by prefix doubling.

Turns get dense numbers (equal turns the same, different turns different ones). A block of 2^k turns is the pair of its two halves, so that one join and one
grouping per power of two name all aligned blocks; a prefix of d turns is the pair of the prefix without the lowest power of two of d and the block of that size that
follows it, so that its name comes from the binary digits of d, in as many rounds again. Equal prefixes thus have equal names, by comparison of whole turns (never of
hashes), in a number of rounds that grows with the logarithm of the longest conversation, whatever the depth of the trie. Nodes are groups of (depth, name).

Sums over subtrees need no walk over the trie: each node counts at its smallest member, so that a node's sum is that over its members of what counts at them from
this depth on, a suffix sum along each conversation.

Skew: one conversation, first turn or whole sequence may hold a third of all rows. Positions come from a sort by ranges with counts for each partition, suffix sums from
blocks of ``STRIP`` turns, groups are summed before they are exchanged, and the ids of a node's ends reach their digest as pieces that ranges of sorted ids were joined to.

Rows without a conversation id belong to no conversation and are left out. Turns go by turn number, null first, then role, then text; a null role or text is empty.
Repeated rows are turns of their own. Other columns are not read, whatever their names. An empty table has no conversations and no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.llm.storage import materialize

#: Turns that one window of a suffix sum holds.
STRIP = 1024
#: Bytes of a piece of joined ids.
PIECE = 1 << 20


def numbered(turns: DataFrame) -> DataFrame:
    """conv, pos (from 0), role, text of each row with a conversation id, null roles and texts as empty."""
    order = ["conv", "turn", "role", "text"]
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # A range partition holds a run of the whole order: its rows number on from what the earlier partitions have of the conversation.
    dealt = rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order))
    dealt = materialize(dealt.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33)), "turns-sorted")
    counts = dealt.groupBy("part", "conv").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "conv", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return dealt.join(starts, ["part", "conv"]).select("conv", (F.col("id") - F.col("first") + F.col("before")).alias("pos"), "role", "text")


def dense_names(frame: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The distinct rows of ``keys`` with a ``name`` each: 1 to their number."""
    spark = frame.sparkSession
    found = materialize(frame.select(keys).distinct().withColumn("id", F.monotonically_increasing_id()), label)
    part = F.shiftright("id", 33)
    sizes = sorted(found.groupBy(part.alias("part")).count().collect())
    offsets, total = [], 0
    for row in sizes:
        offsets.append((row["part"], total))
        total += row["count"]
    # One row for each partition of the exchange above.
    base = spark.createDataFrame(offsets, "part long, base long")
    return found.withColumn("part", part).join(F.broadcast(base), "part").select(*keys, (F.col("base") + F.col("id").bitwiseAND((1 << 33) - 1) + 1).alias("name"))


def named(frame: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``frame`` with equal ``keys`` replaced by their ``name``."""
    return frame.join(dense_names(frame, keys, f"{label}-names"), keys).drop(*keys)


def prefix_names(turns: DataFrame) -> DataFrame:
    """(conv, d, name) for each prefix of d >= 1 turns, from (conv, pos, name of the turn); names are equal for equal sequences."""
    longest = turns.agg(F.max("pos")).first()[0]
    top = -1 if longest is None else (longest + 1).bit_length() - 1
    blocks = [turns.select("conv", F.col("pos").alias("block"), "name")]
    for k in range(1, top + 1):
        half = blocks[-1].select("conv", F.shiftright("block", 1).alias("block"), (F.col("block") % 2 == 0).alias("left"), "name")
        pairs = half.groupBy("conv", "block").agg(F.max(F.when(F.col("left"), F.col("name"))).alias("a"), F.max(F.when(~F.col("left"), F.col("name"))).alias("b"))
        blocks.append(materialize(named(pairs.where("a IS NOT NULL AND b IS NOT NULL"), ["a", "b"], f"blocks-{k}"), f"blocks-{k}"))
    done = None
    for k in range(top, -1, -1):
        # Prefixes whose lowest power of two is 2^k: 2^k, 3 * 2^k, 5 * 2^k, ...; an even block ends one of them.
        last = blocks[k].where("block % 2 = 0").select("conv", F.expr(f"block << {k}").alias("d"), F.col("name").alias("b"))
        root = last.where("d = 0").select("conv", "d", F.lit(0).cast("long").alias("a"), "b")
        later = last.where("d > 0").join(done.withColumnRenamed("name", "a"), ["conv", "d"]).select("conv", "d", "a", "b") if done is not None else None
        pairs = root if later is None else root.union(later)
        step = named(pairs, ["a", "b"], f"prefixes-{k}").select("conv", (F.col("d") + (1 << k)).alias("d"), "name")
        step = materialize(step, f"prefixes-{k}")
        done = step if done is None else done.union(step)
    return done if done is not None else turns.select("conv", F.col("pos").alias("d"), "name").limit(0)


def suffix_sums(frame: DataFrame, values: list[str]) -> DataFrame:
    """``frame`` (conv, d, ...) with each of ``values`` summed over the conversation from d on."""
    strip = F.floor(F.col("d") / STRIP)
    within = Window.partitionBy("conv", "strip").orderBy(F.desc("d"))
    after = Window.partitionBy("conv").orderBy(F.desc("strip")).rowsBetween(Window.unboundedPreceding, -1)
    cut = frame.withColumn("strip", strip)
    totals = cut.groupBy("conv", "strip").agg(*(F.sum(v).alias(v) for v in values))
    later = totals.select("conv", "strip", *(F.coalesce(F.sum(v).over(after), F.lit(0)).alias(f"{v}_later") for v in values))
    running = cut.select("*", *(F.sum(v).over(within).alias(f"{v}_here") for v in values))
    joined = running.join(later, ["conv", "strip"])
    return joined.select(*(c for c in frame.columns if c not in values), *((F.col(f"{v}_here") + F.col(f"{v}_later")).alias(v) for v in values))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of equal nodes, in order, to comma-joined strings of at most about ``PIECE`` bytes, each with its first id."""
    node, first, ids, size = None, None, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"d": pa.array([node[0]], pa.int64()), "name": pa.array([node[1]], pa.int64()), "first": pa.array([first], pa.int64()), "ids": [",".join(ids)]})

    for batch in batches:
        for d, name, conv in zip(*(batch.column(c).to_pylist() for c in ("d", "name", "conv")), strict=True):
            if (d, name) != node or size > PIECE:
                if ids:
                    yield out()
                node, first, ids, size = (d, name), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in order."""
    node, sha = None, None
    for batch in batches:
        done = []
        for d, name, ids in zip(*(batch.column(c).to_pylist() for c in ("d", "name", "ids")), strict=True):
            if (d, name) == node:
                sha.update(b",")
            else:
                if node is not None:
                    done.append((*node, sha.hexdigest()))
                node, sha = (d, name), hashlib.sha256()
            sha.update(ids.encode())
        yield _hashes(done)
    if node is not None:
        yield _hashes([(*node, sha.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    d, name, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({"d": pa.array(d, pa.int64()), "name": pa.array(name, pa.int64()), "ends_sha256": pa.array(sha, pa.string())})


def end_digests(ends: DataFrame) -> DataFrame:
    """(d, name, ends_sha256) over the conversations (d, name, conv) that end in a node."""
    ranged = ends.select("d", "name", "conv").repartitionByRange("d", "name", "conv").sortWithinPartitions("d", "name", "conv")
    pieces = ranged.mapInArrow(_pieces, "d long, name long, first long, ids string")
    return pieces.repartition("d", "name").sortWithinPartitions("d", "name", "first").mapInArrow(_digests, "d long, name long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the conversations ``convs`` (conv) with ``turns`` (conv, pos from 0 without gaps, name of the turn, bytes of its text).

    Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    prefixes = prefix_names(turns.select("conv", "pos", "name"))
    rooted = prefixes.select("conv", "d", "name").union(convs.select("conv", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("name")))
    sizes = turns.groupBy("conv").agg(F.count("*").alias("length"))
    lengths = convs.join(sizes, "conv", "left").select("conv", F.coalesce("length", F.lit(0)).alias("length"))
    # The parent of (conv, d) is (conv, d - 1), its last text that of turn d - 1.
    parents = rooted.select("conv", (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    lasts = turns.select("conv", (F.col("pos") + 1).alias("d"), "bytes")
    members = rooted.join(parents, ["conv", "d"], "left").join(lasts, ["conv", "d"], "left").join(lengths, "conv")
    members = materialize(members, "trie-members")
    nodes = members.groupBy("d", "name").agg(
        F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"), F.max("length").alias("deepest")
    )
    nodes = materialize(nodes, "trie-nodes")
    own = nodes.select(
        F.col("rep").alias("conv"), "d", ((F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))).alias("saved"), (F.col("deepest") == F.col("d")).cast("long").alias("leaf")
    )
    counted = members.select("conv", "d", "name").join(own, ["conv", "d"], "left").select(
        "conv", "d", "name", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    sums = suffix_sums(counted, ["saved", "leaf"]).groupBy("d", "name").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("name").alias("parent"), F.col("rep").alias("parent_conv_id"))
    ends = end_digests(members.where("d = length"))
    out = nodes.join(sums, ["d", "name"]).join(children, ["d", "name"], "left").join(ends, ["d", "name"], "left").join(above, ["d", "parent"], "left")
    return out.select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def with_shared_heads(turns: DataFrame, most: int = 9, group: int = 5) -> DataFrame:
    """(conv, pos, name, bytes): each conversation c with its first h turns replaced by those of conversation c - c % ``group`` (as many as that has), h being the unsigned
    CRC-32 of the decimal id modulo ``most``. From (conv, pos, name, bytes)."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    source = F.col("conv") - F.col("conv") % group
    heads = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv", "source")
    convs = turns.select("conv").distinct().select("conv", h.alias("h"), source.alias("source"))
    lent = convs.join(heads, "source").where("pos < h").select("conv", "pos", "name", "bytes")
    had = lent.groupBy("conv").agg(F.count("*").alias("had"))
    own = turns.withColumn("h", h).where("pos >= h").join(had, "conv", "left")
    return lent.union(own.select("conv", (F.col("pos") - F.col("h") + F.coalesce("had", F.lit(0))).alias("pos"), "name", "bytes"))


def conversation_trie(turns: DataFrame, shared_heads: bool = False) -> DataFrame:
    """The trie of ``turns`` (conv_id, turn, role, text); with ``shared_heads`` of the rebuilt conversations, even those left without turns."""
    placed = materialize(numbered(turns), "turns-numbered")
    words = placed.select("conv", "pos", "role", "text", F.octet_length("text").cast("long").alias("bytes"))
    dense = materialize(named(words, ["role", "text"], "turns"), "turns-named").select("conv", "pos", "name", "bytes")
    convs = dense.select("conv").distinct()
    if shared_heads:
        dense = materialize(with_shared_heads(dense), "turns-rebuilt")
    return trie(dense, convs)
