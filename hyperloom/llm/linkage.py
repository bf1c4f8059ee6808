"""Connected groups over links, without emitting all pairs of a group.

Three steps, shared by the line and the document near-duplicate operators:

1. ``block_links``: rows that share a candidate key meet in one sorted run. Within the run only a spanning forest of
   the pairs that pass a cheap, lossless test (or an exact one) leaves the task.
2. ``connected_components``: alternating large-star and small-star rounds of joins.
3. ``place_members`` and ``link_members``: the members of a candidate component meet with what an exact comparison needs, and links
   are searched from one member outwards, so members already joined are not compared again. Components over a size limit are
   split into chunks, and every pair of chunks is a task of its own; no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.llm.storage import materialize

EDGE = "a long, b long"
_EDGE_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Up to so many rows of one key are tested pair by pair where lengths bound the pairs; larger runs are searched from member to member.
MEDIUM = 1000
#: Pairs of an exact test at once, at first and at most.
BATCH, MANY = 1024, 16_384


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (smallest member, other member) with the same connected groups as the edges (a, b)."""
    if len(a) == 0:
        return a, b
    ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(ids))
    return ids[label[other]], ids[other]


def block_links(
    rows: DataFrame,
    key: str,
    ident: str,
    features: list[str],
    load: Callable[[pa.RecordBatch], dict[str, np.ndarray]],
    near: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray],
    search: Callable[[dict[str, np.ndarray]], Callable[[int, np.ndarray], np.ndarray]] | None = None,
    small: int = 12,
    buffer_rows: int = 200_000,
    window: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]] | None = None,
    exact: Callable[[dict[str, np.ndarray]], Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Star edges that connect what ``near`` connects among rows with equal ``key``.

    ``load`` turns an Arrow table of rows into arrays, ``near(features, i, j)`` tests row pairs, and ``search`` may build an
    index for large runs: ``search(features)(i, open_rows)`` gives the open rows that i reaches. With ``window(features)``, a number for each row and
    the largest number of its partners (of the larger number), runs of up to MEDIUM rows are tested pair by pair in bulk. With ``exact(features)``, a test of row
    pairs too, only pairs that also pass it are connected; it is left out for pairs of ids that a task has connected already. Without ``tasks`` the session decides on their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = table[key].combine_chunks().to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(edge, len(keys)))
            wanted = np.repeat(sizes > 1, sizes)
            if not wanted.any():
                return
            table = table.filter(pa.array(wanted))
            keys, sizes = keys[wanted], sizes[sizes > 1]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            ids = table[ident].combine_chunks().to_numpy(zero_copy_only=False)
            data = load(table)
            found_a, found_b = [], []
            confirm, tops = confirmed(ids, exact(data)) if exact else (None, None)

            def keep(i: np.ndarray, j: np.ndarray) -> None:
                if confirm:
                    ok = confirm(i, j)
                    i, j = i[ok], j[ok]
                a, b = ids[i], ids[j]
                if len(a) > 100_000:
                    a, b = forest(a[a != b], b[a != b])
                found_a.append(a)
                found_b.append(b)

            limit = MEDIUM if window else small
            in_small = np.repeat(sizes <= limit, sizes)
            if window:
                for i, j in windowed_pairs(np.flatnonzero(in_small), np.repeat(np.arange(len(sizes)), sizes), *window(data)):
                    ok = near(data, i, j)
                    keep(i[ok], j[ok])
            for step in range(1, 0 if window else small):
                i = np.flatnonzero(in_small[:-step] & (keys[:-step] == keys[step:]))
                if len(i) == 0:
                    break
                for part in np.array_split(i, len(i) // 100_000 + 1):
                    part = part[near(data, part, part + step)]
                    keep(part, part + step)
            for k in np.flatnonzero(sizes > limit):
                members = np.arange(starts[k], starts[k] + sizes[k])
                if confirm:
                    for i, j in unlike_pairs(members, tops):
                        ok = near(data, i, j)
                        keep(i[ok], j[ok])
                    continue
                reach = search({n: v[members] for n, v in data.items()}) if search else None
                reach = reach or (lambda i, to, m=members: near(data, np.full(len(to), m[i]), m[to]))
                left, right = spread(len(members), reach)
                found_a.append(ids[members[left]])
                found_b.append(ids[members[right]])
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                a, b = forest(a[a != b], b[a != b])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGE_ARROW)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= buffer_rows:
                table = pa.Table.from_batches(held)
                keys = table[key].combine_chunks().to_numpy(zero_copy_only=False)
                cut = int(np.searchsorted(keys, keys[-1], side="left"))  # the last key may go on in the next batch
                if cut:
                    yield from links(table.slice(0, cut))
                    held, count = table.slice(cut).to_batches(), len(keys) - cut
        if held:
            yield from links(pa.Table.from_batches(held))

    rows = rows.select(key, ident, *features)
    ordered = (rows.repartition(tasks, key) if tasks else rows.repartition(key)).sortWithinPartitions(key)
    return ordered.mapInArrow(run, EDGE)


def windowed_pairs(rows: np.ndarray, run: np.ndarray, value: np.ndarray, most: np.ndarray, batch: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of ``rows`` of the same run with value[i] <= value[j] <= most[i], about ``batch`` at once."""
    rows = rows[np.lexsort([value[rows], run[rows]])]
    place = run[rows].astype(np.int64) << 32
    last = np.searchsorted(place + value[rows], place + np.minimum(most[rows], (1 << 32) - 1), side="right")
    count = last - np.arange(len(rows)) - 1
    done = np.cumsum(count)
    low = 0
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + batch, side="right")))
        size = count[low:high]
        first = np.repeat(np.arange(low, high), size)
        yield rows[first], rows[first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)]
        low = high


def unlike_pairs(rows: np.ndarray, tops: Callable[[np.ndarray], np.ndarray], seeds: int = 16, batch: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``rows`` but those that are connected already as ``tops`` tells between the batches: at first a few rows with all others, which connects large groups of like rows, then every pair of different groups."""
    open_ = rows
    for _ in range(seeds):
        if len(open_) > 1:
            yield np.full(len(open_) - 1, open_[0]), open_[1:]
            found = tops(open_)
            open_ = open_[found != found[0]]
    group = tops(rows)
    order = np.argsort(group, kind="stable")
    rows, group = rows[order], group[order]
    after = np.searchsorted(group, group, side="right")
    count = len(rows) - after
    done = np.cumsum(count)
    low = 0
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + batch, side="right")))
        size = count[low:high]
        yield rows[np.repeat(np.arange(low, high), size)], rows[np.repeat(after[low:high], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        low = high


def confirmed(ids: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    """Which of the row pairs given to it to keep: those that pass ``test`` and whose ids no kept pair has connected before. A pair of ids is tested once. Pairs are tested many at once, fewer where those before
    them in a batch would have made many needless. Beside this function, one that tells the group of each row."""
    codes = np.unique(ids, return_inverse=True)[1]
    up = list(range(len(ids)))
    failed: set[tuple[int, int]] = set()
    many = BATCH

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def run(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        nonlocal many
        kept = np.zeros(len(i), bool)
        pairs = list(zip(codes[i].tolist(), codes[j].tolist(), strict=True))
        at = 0
        while at < len(pairs):
            wanted: dict[tuple[int, int], int] = {}
            while at < len(pairs) and len(wanted) < many:
                x, y = pairs[at]
                pair = (x, y) if x < y else (y, x)
                if pair not in wanted and pair not in failed and top(x) != top(y):
                    wanted[pair] = at
                at += 1
            places = np.fromiter(wanted.values(), np.int64, len(wanted))
            needless = 0
            for (x, y), place, good in zip(wanted, places.tolist(), test(i[places], j[places]).tolist() if len(places) else (), strict=True):
                left, right = top(x), top(y)
                if not good:
                    failed.add((x, y))
                elif left != right:
                    up[right] = left
                    kept[place] = True
                else:
                    needless += 1
            many = max(64, many // 2) if needless * 8 > len(wanted) else min(MANY, many * 2)
        return kept

    return run, lambda rows: np.array([top(x) for x in codes[rows].tolist()], np.int64)


def spread(count: int, reach: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest over 0..count-1, searching from each reached member among the members still open."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    open_ = np.arange(count)
    while len(open_):
        queue, open_ = [int(open_[0])], open_[1:]
        while queue and len(open_):
            i = queue.pop()
            hit = reach(i, open_)
            if hit.any():
                got = open_[hit]
                left.append(np.full(len(got), i))
                right.append(got)
                queue.extend(got.tolist())
                open_ = open_[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def connected_components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """(id, root) for every end of an edge; root is the smallest id of its connected group.

    Large-star then small-star in each round, each one aggregate and one join, so hot ids are split by adaptive
    execution; the table of each round ends its lineage.
    """
    edges = edges.select("a", "b").where("a != b")
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)

    def checksum(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) % 1000003"))).first())

    before = checksum(edges)
    for step in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.where("u != v").distinct(), f"{label}-{step}")
        after = checksum(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return ends.union(ends.select(F.col("root").alias("id"), "root").distinct())


def place_members(components: DataFrame, chunk: int = 2000, label: str = "placed") -> DataFrame:
    """(comp, i, j, id) from (id, root): the tasks that each member of a candidate component takes part in.

    Components of at most ``chunk`` members are one task, (0, 0); of larger ones every pair of chunks is one.
    """
    members = materialize(components.select(F.col("root").alias("comp"), "id"), f"{label}-members")
    sizes = members.groupBy("comp").agg(F.count("*").alias("size"))
    order = Window.partitionBy("comp").orderBy("id")
    split = members.join(sizes.where(F.col("size") > chunk), "comp").select(
        "id", F.floor((F.row_number().over(order) - 1) / chunk).cast("int").alias("part"), F.ceil(F.col("size") / chunk).cast("int").alias("parts")
    )
    split = split.select("id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "part")
    split = split.select("id", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    placed = members.join(split, "id", "left").select("comp", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("j", F.lit(0)).alias("j"), "id")
    return materialize(placed, label)


def link_members(members: DataFrame, link: Callable[..., tuple[np.ndarray, np.ndarray]], label: str = "links", known: DataFrame | None = None, together: bool = False) -> DataFrame:
    """(id, root) of placed members (comp, i, j, id, and what ``link`` needs) that ``link``, or the links ``known`` (a, b) beside them, connect.

    ``link(columns)`` returns positions of a spanning forest of the true links among the rows of a task, given as arrays by column; with ``together`` it gets the rows of many tasks and, as a second argument, the number of
    each row's task, and no link may leave its task.
    """

    task = ["comp", "i", "j"]

    def changes(table: pa.Table) -> np.ndarray:
        """Where in ``table`` tasks start."""
        keys = np.stack([table[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in task])
        return np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))

    def links(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns, found = {c: table[c].to_numpy() for c in table.column_names}, []
        if together:
            left, right = link(columns, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows))))
            if len(left):
                found.append((columns["id"][left], columns["id"][right]))
        for low, high in () if together else zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            if high - low > 1:
                left, right = link({c: v[low:high] for c, v in columns.items()})
                if len(left):
                    found.append((columns["id"][low:high][left], columns["id"][low:high][right]))
        if found:
            a, b = forest(*(np.concatenate(ends) for ends in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGE_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([*held, batch])
            starts = changes(table)
            if len(starts) > 1:
                # The last task may go on in the next batch.
                yield from links(table.slice(0, starts[-1]), starts[:-1])
            held = table.slice(starts[-1]).to_batches()
        if held:
            yield from links(pa.Table.from_batches(held), np.zeros(1, np.int64))

    # Most tasks have two or three members: a partition of them is one sorted run, cut where the task changes.
    ordered = members.repartition(*task).sortWithinPartitions(*task, "id")
    edges = materialize(ordered.mapInArrow(run, EDGE), label)
    return connected_components(edges if known is None else edges.union(known), f"{label}-components")
