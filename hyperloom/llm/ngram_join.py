"""N-gram Jaccard self-join by a count-vector R-tree.

A document's set holds its distinct 4-word shingles (64-bit hashes; words as [^\\x20\\x09-\\x0D]+, A-Z folded). Shingles are hashed into 32 groups, and the
vector of group counts is a point. The sum over groups of the smaller coordinate bounds the overlap of two sets from above, and the sum of min(query
coordinate, largest coordinate in a box) bounds it for a whole box, so a tree over boxes of points gives every pair that can reach the threshold.

One tree over all points would need every point to meet most boxes, since count vectors of unrelated long texts look alike. So large sets are cut by hash into
parts of some hundred shingles, the same way in both documents of a pair: where the whole sets overlap in a share of their sizes, one of the parts does
too. And trees are built for runs of documents whose parts share a shingle among the first few, in one fixed order (shingles that are frequent
last, then by hash): parts that overlap so much always do. Pairs that pass the bound join candidate components; inside each,
exact overlaps are verified with the whole sets.

Which shingles count as frequent only moves work; any choice gives the same links. Null, empty and blank texts have empty sets and link with nothing; texts of fewer
words have one shingle of all their words. Equal sets link. Rows without an id get no component. Rows that repeat an id count as one document. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.linkage import block_links, connected_components, link_members, place_members, spread
from hyperloom.llm.storage import materialize
from hyperloom.llm.textvec import SPACED, Words, blocks, grams, mix64, sequence_hash, utf8

WIDTH, NUMERATOR, DENOMINATOR, GROUPS = 4, 85, 100, 32
#: Sets up to PART_SIZE have one part, up to four times as many shingles four, and so on.
PART_SIZE, PART_STEP = 700, 4
MOST_FREQUENT, FREQUENT_IN, FREQUENT_BYTES = 65_536, 16, 32 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block."""
    words = Words(data, offsets, SPACED)
    hashes = grams(words.hash, width)
    whole = sequence_hash(words.hash, words.first)
    first = words.first.tolist()
    none = np.zeros(0, np.uint64)
    return [np.unique(hashes[a : b - width + 1]) if b - a >= width else (whole[d : d + 1] if b > a else none) for d, (a, b) in enumerate(zip(first, first[1:], strict=False))]


def needed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest overlap of sets of sizes a and b at which they link."""
    return -(-num * (a + b) // (num + den))


def part_counts(n: int, num: int, den: int) -> list[int]:
    """The numbers of parts in which a set of n shingles may meet a linked one."""
    def parts(m: int) -> int:
        count = 1
        while m > PART_SIZE * count:
            count *= PART_STEP
        return count

    # A pair meets in the parts of its larger set.
    return sorted({parts(n), parts(n * den // num)})


def frequent_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """Hashes that occur at least FREQUENT_IN times in some stretch of text; the MOST_FREQUENT most frequent, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            hot = n >= FREQUENT_IN
            return pa.RecordBatch.from_arrays([pa.array(keys[hot].view(np.int64)), pa.array(n[hot])], names=["shingle", "n"])

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in blocks(offsets):
                held.append(grams(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACED).hash, WIDTH))
                size += int(offsets[j] - offsets[i])
                if size >= FREQUENT_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    counts = docs.select(text).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).select("shingle").toArrow()["shingle"]  # at most 512 KB
    return np.sort(top.to_numpy().view(np.uint64))


def sketches(docs: DataFrame, ident: str, text: str, frequent: np.ndarray, num: int, den: int) -> DataFrame:
    """(doc_id, n, k1, k2, parts): set size, a 128-bit name of the set, and for each part its number of parts, size, group counts and first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                first = np.concatenate([[0], np.cumsum(sizes)])
                one, two = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (0x1234567, 0x7654321))
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
                    hot = frequent[at] == flat
                else:
                    hot = np.zeros(len(flat), bool)
                # A row for each part of each set: owner, number of parts, members in their order.
                owners, splits, members, lengths = [], [], [], []
                for d, n in enumerate(sizes.tolist()):
                    if n == 0:
                        continue
                    own = np.arange(first[d], first[d + 1])
                    h = hot[own]
                    if h.any():
                        own = np.concatenate([own[~h], own[h]])
                    for count in part_counts(n, num, den):
                        if count == 1:
                            groups = [own]
                        else:
                            part = (flat[own] % np.uint64(count)).astype(np.int64)
                            groups = [own[part == k] for k in range(count)]
                        for g in groups:
                            owners.append(d)
                            splits.append(count)
                            members.append(g)
                            lengths.append(len(g))
                owner, split, length = (np.array(x, np.int64) for x in (owners, splits, lengths))
                member = np.concatenate(members) if members else np.zeros(0, np.int64)
                row = np.repeat(np.arange(len(owner)), length)
                vectors = np.bincount(row * GROUPS + (flat[member] >> np.uint64(59)).astype(np.int64), minlength=len(owner) * GROUPS).reshape(-1, GROUPS)
                # Of a whole set all but ceil(share * n) can be missing in a partner; of a part, whose partner may be smaller or larger, at
                # most (1 - share) / share of its size.
                take = np.where(split == 1, length - -(-num * length // den), length * (den - num) // num) + 1
                take = np.minimum(take, length)
                start = np.cumsum(length) - length
                chosen = member[np.arange(int(take.sum())) + np.repeat(start - (np.cumsum(take) - take), take)]
                keys = mix64(flat[chosen] ^ np.repeat(split.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), take))
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(keys.view(np.int64)))
                parts = pa.StructArray.from_arrays([pa.array(split.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(pack_counts(vectors), pa.binary()), tokens], names=["split", "size", "counts", "tokens"])
                per = np.bincount(owner, minlength=len(sets)) if len(owner) else np.zeros(len(sets), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes), pa.array((one[first[1:]] - one[first[:-1]]).view(np.int64)), pa.array((two[first[1:]] - two[first[:-1]]).view(np.int64)), lists],
                    names=["doc_id", "n", "k1", "k2", "parts"],
                )

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(run, f"doc_id {kind}, n long, k1 long, k2 long, parts array<struct<split:int,size:int,counts:binary,tokens:array<long>>>")


def repeated_keys(rows: DataFrame) -> DataFrame:
    """The distinct rows (key, id, slot) whose key is in another distinct row too, in one pass over sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row of a batch waits for the first key of the next one.
        held, again = None, False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            equal = [x[1:] == x[:-1] for x in (c.to_numpy() for c in table.itercolumns())]
            table = table.filter(pa.array(np.append(True, ~np.logical_and.reduce(equal)))).combine_chunks()
            keys = table["key"].to_numpy()
            same = np.concatenate([[again], keys[1:] == keys[:-1], [False]])
            yield from table.slice(0, len(keys) - 1).filter(pa.array(same[:-2] | same[1:-1])).to_batches()
            held, again = table.slice(len(keys) - 1).to_batches()[0], bool(same[-2])
        if held is not None and again:
            yield held

    return rows.repartition("key").sortWithinPartitions(*rows.columns).mapInArrow(run, rows.schema)


def pack_counts(vectors: np.ndarray) -> list[bytes]:
    """A shift and a byte for each count, rounded up so that bounds stay bounds."""
    if len(vectors) == 0:
        return []
    most = vectors.max(axis=1)
    shift = np.maximum(0, np.ceil(np.log2(np.maximum(most, 1) / 255)).astype(np.int64))
    rounded = -(-vectors // (1 << shift)[:, None])
    return [bytes(row) for row in np.hstack([shift[:, None], rounded]).astype(np.uint8)]


def load_points(table: pa.Table) -> dict[str, np.ndarray]:
    raw, _ = utf8(table["counts"])
    raw = raw.reshape(-1, GROUPS + 1)
    numbers = {c: table[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "size")}
    return numbers | {"c": raw[:, 1:].astype(np.int32) << raw[:, :1].astype(np.int32)}


def near_points(num: int, den: int) -> Callable:
    def near(data: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = data["n"][i], data["n"][j]
        ok = np.minimum(a, b) * den >= np.maximum(a, b) * num
        at = np.flatnonzero(ok)
        overlap = np.minimum(data["c"][i[at]], data["c"][j[at]]).sum(axis=1)
        ok[at] = overlap * (num + den) >= (data["size"][i[at]] + data["size"][j[at]]) * num
        return ok

    return near


class CountTree:
    """Packed R-tree over points of group counts and set sizes: boxes keep the largest counts, the smallest part and the range of set sizes."""

    FANOUT = 16

    def __init__(self, data: dict[str, np.ndarray], num: int, den: int):
        self.data, self.num, self.den = data, num, den
        n, c = data["n"], data["c"]
        slab = np.argsort(np.argsort(n, kind="stable")) // max(1, int((len(n) * self.FANOUT) ** 0.5))
        self.order = np.lexsort((c[:, 1], c[:, 0] - c[:, 2], slab))
        levels = [(c[self.order], n[self.order], n[self.order], data["size"][self.order])]
        while len(levels[-1][0]) > self.FANOUT:
            top, low, high, size = levels[-1]
            at = np.arange(0, len(top), self.FANOUT)
            levels.append((np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(size, at)))
        self.levels = levels

    def search(self, i: int) -> np.ndarray:
        """Points whose bound with point i reaches the threshold."""
        q, n = self.data["c"][i], self.data["n"][i]
        boxes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high, size = (x[boxes] for x in self.levels[depth])
            ok = (low * self.num <= n * self.den) & (high * self.den >= n * self.num)
            overlap = np.minimum(top[ok], q).sum(axis=1)
            ok[ok] = overlap * (self.num + self.den) >= (self.data["size"][i] + size[ok]) * self.num
            boxes = boxes[ok]
            if depth:
                boxes = (boxes[:, None] * self.FANOUT + np.arange(self.FANOUT)).ravel()
                boxes = boxes[boxes < len(self.levels[depth - 1][0])]
        return self.order[boxes]

    def reach(self, i: int, to: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(self.order), bool)
        hit[self.search(i)] = True
        return hit[to]


def verify(columns: dict[str, np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the exact links among the whole sets of compressed texts (blob)."""
    reader = zstandard.ZstdDecompressor()
    sets = []
    for blob in columns["blob"]:
        data = np.frombuffer(reader.decompress(blob), np.uint8)
        sets += shingle_sets(data, np.array([0, len(data)]))
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]

    def reach(i: int, to: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        size = high - low
        at = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
        shared = np.bincount(owner[at], minlength=len(n))[to]
        return (shared >= needed(n[i], n[to], num, den)) & (shared > 0)

    return spread(len(n), reach)


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row. Rows that repeat an id are one document with the links of all their texts, and share its component."""
    frequent = frequent_shingles(docs, text)
    table = materialize(sketches(docs, ident, text, frequent, num, den), "sketches")
    linkable = table.where("doc_id IS NOT NULL AND n > 0")
    # Equal sets are one: the smallest id stands for them, with partial aggregation before the shuffle.
    classes = linkable.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = materialize(classes.where("copies > 1").select("k1", "k2", "n", "rep"), "set-copies")
    # The number of copies grows with the documents: the same join at every size here as well. A row goes for its set, not for its id.
    points = linkable.join(copies.hint("merge"), ["k1", "k2", "n"], "left").where("rep IS NULL OR doc_id = rep")
    # An id with several sets is one document: it is linked to what stands for each of them.
    named_sets = table.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n")).alias("low"), F.max(F.struct("k1", "k2", "n")).alias("high"))
    several = named_sets.where("low != high").select("doc_id")
    known = linkable.join(several.hint("merge"), "doc_id").join(copies, ["k1", "k2", "n"]).where("doc_id != rep")
    known = known.select(F.col("doc_id").cast("long").alias("a"), F.col("rep").cast("long").alias("b")).distinct()
    parts = points.select(F.col("doc_id").cast("long").alias("id"), "n", F.posexplode("parts").alias("slot", "p"))
    # Most leading shingles are in one set only: ids alone are sorted by shingle first, and the counts follow to those that are shared.
    shared = repeated_keys(parts.select(F.explode("p.tokens").alias("key"), "id", "slot"))
    vectors = parts.select(F.col("id").alias("of"), F.col("slot").alias("at"), "n", "p.size", "p.counts")
    rows = shared.join(vectors.hint("merge"), (F.col("id") == F.col("of")) & (F.col("slot") == F.col("at"))).select("key", "id", "n", "size", "counts")
    search = lambda data: CountTree(data, num, den).reach
    edges = block_links(rows, "key", "id", ["n", "size", "counts"], load_points, near_points(num, den), search)
    placed = place_members(connected_components(edges, "set-candidates"), label="set-members")

    # Texts travel compressed and become sets again where they meet: a hash of 8 bytes a shingle would be several times as much.
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            blobs = [packer.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["id", "blob"])

    texts = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL").mapInArrow(squeeze, "id long, blob binary")
    # The same join at every size: a broadcast of the members is only possible while they are few.
    links = link_members(placed.hint("merge").join(texts, "id"), lambda columns: verify(columns, num, den), label="set-links", known=known)
    roots = links.select(F.col("id").alias("rep"), "root")
    own = table.select("doc_id", "n", "k1", "k2").join(copies, ["k1", "k2", "n"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    named = own.join(roots, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").cast("long").alias("component_id"))
    return named
