"""Helpers of ``frontier`` for small graphs as rows (see ``packed``): the same waves, ranks and trees, with vertex sets as bit masks, inside one graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

from hyperloom.operators import packed

#: A subproblem: its edges' ids in order, and its specials as masks.
Key = tuple[tuple[int, ...], frozenset[int]]


def parts_of(masks: list[tuple[int, int]], specials: frozenset[int], gone: int) -> list[tuple[list[int], list[int]]]:
    """(edges, specials) of the components without the vertices in ``gone``; edges inside it are in none, each special inside it is one of its own."""
    found: list[tuple[int, list[int], list[int]]] = []
    for e, s, rest in [*((e, None, m & ~gone) for e, m in masks if m & ~gone), *((None, s, s & ~gone) for s in specials)]:
        es, ss, apart = [] if e is None else [e], [] if s is None else [s], []
        for part in found:
            if part[0] & rest:
                rest |= part[0]
                es += part[1]
                ss += part[2]
            else:
                apart.append(part)
        found = [*apart, (rest, es, ss)]
    return [(es, ss) for _, es, ss in found]


@lru_cache(maxsize=1 << 16)
def places(rank: int, n: int, k: int) -> tuple[int, ...]:
    """Positions of the candidate of a rank, as ``frontier.unrank``."""
    while rank >= comb(n, k):
        rank, k = rank - comb(n, k), k - 1
    found, top = [], n
    for j in range(k, 0, -1):
        top = next(c for c in range(top - 1, -1, -1) if comb(c, j) <= rank)
        rank -= comb(top, j)
        found.append(top)
    return tuple(reversed(found))


def search_rows(k: int, first: int, growth: int, most: int, waves: int) -> Callable[..., Iterator[tuple]]:
    """(verdict, subproblems, node, parent, bag, cover) of one graph: ``frontier.solve`` and ``frontier.trees_of``; without a tree one row without a node."""

    def run(edges: dict[int, int], vertices: list[int]) -> Iterator[tuple]:
        limit_of = lambda key: (len(key[0]) + len(key[1])) // 2
        based = lambda key: len(key[0]) + len(key[1]) <= 2 or (len(key[0]) <= k and len(key[1]) <= 1)
        named = {}

        def name(key: Key) -> str:
            """The key as ``frontier.with_key`` writes it, which orders the parts."""
            if key not in named:
                named[key] = ",".join(map(str, key[0])) + "|" + ";".join(",".join(map(str, vs)) for vs in sorted(sorted(packed.bits(s, vertices)) for s in key[1]))
            return named[key]

        cuts: dict[Key, list[tuple[int, int]]] = {}

        def block(key: Key, cursor: int, attempt: int) -> tuple[int, int, list[tuple[int, int, tuple[int, ...]]]]:
            """The end of the block looked at, all ranks, and its different hits (rank, separator, cover)."""
            masks = [(e, edges[e]) for e in key[0]]
            if key not in cuts:
                inside = 0
                for _, m in masks:
                    inside |= m
                for s in key[1]:
                    inside |= s
                firsts: dict[int, int] = {}
                for e, m in edges.items():
                    if m & inside:
                        firsts.setdefault(m & inside, e)
                cuts[key] = [(e, m) for m, e in firsts.items()]
            parts = cuts[key]
            until = sum(comb(len(parts), m) for m in range(1, k + 1))
            low, size, limit = cursor, min(first * growth**attempt, most), limit_of(key)
            while True:
                end = min(low + size, until)
                hits: dict[int, tuple[int, tuple[int, ...]]] = {}
                for rank in range(low, end):
                    sep, chosen = 0, places(rank, len(parts), k)
                    for p in chosen:
                        sep |= parts[p][1]
                    if sep not in hits and sep not in key[1] and all(len(es) + len(ss) <= limit for es, ss in parts_of(masks, key[1], sep)):
                        hits[sep] = rank, chosen
                if hits or end >= until:
                    return max(end, cursor), until, [(rank, sep, tuple(dict.fromkeys(parts[p][0] for p in chosen))) for sep, (rank, chosen) in hits.items()]
                low, size = end, size * growth

        root: Key = tuple(edges), frozenset()
        status = {root: "yes" if based(root) else "open"}
        place = {root: (0, 0)}  # cursor, attempt; None once all ranks are looked at
        active: dict[Key, dict[int, list[Key]]] = {}
        covers: dict[tuple[Key, int], tuple[int, tuple[int, ...]]] = {}
        chosen: dict[Key, tuple[int, list[Key]]] = {}
        for _ in range(waves):
            if status[root] != "open":
                break
            wanted = {kid for ranks in active.values() for kids in ranks.values() for kid in kids} | {root}
            for key in [key for key in wanted if status[key] == "open" and key not in active]:
                cursor, attempt = place[key]
                end, until, hits = block(key, cursor, attempt)
                place[key] = end, None if end >= until else attempt + 1
                if not hits:
                    status[key] = "no"
                for rank, sep, cover in hits:
                    kids = []
                    for es, ss in parts_of([(e, edges[e]) for e in key[0]], key[1], sep):
                        kid: Key = tuple(sorted(es)), frozenset({*ss, sep})
                        kids.append(kid)
                        if kid not in status:
                            status[kid], place[kid] = "yes" if based(kid) else "open", (0, 0)
                    active.setdefault(key, {})[rank] = kids
                    covers[key, rank] = sep, cover
            while True:
                good = {(key, rank) for key, ranks in active.items() for rank, kids in ranks.items() if all(status[kid] == "yes" for kid in kids)}
                bad = {(key, rank) for key, ranks in active.items() for rank, kids in ranks.items() if any(status[kid] == "no" for kid in kids)}
                if not good and not bad:
                    break
                for key in {key for key, _ in good}:
                    rank = min(r for x, r in good if x == key)
                    chosen[key] = rank, active.pop(key)[rank]
                    status[key] = "yes"
                for key, rank in bad:
                    if key in active:
                        active[key].pop(rank)
                        if not active[key]:
                            del active[key]
                            if status[key] == "open" and place[key][1] is None:
                                status[key] = "no"
        if status[root] != "yes":
            yield status[root], len(status), None, None, None, None
            return
        for row in tree(root, chosen, covers, name):
            yield "yes", len(status), *row_of(row, edges, vertices)

    def row_of(row: tuple, edges: dict[int, int], vertices: list[int]) -> tuple:
        node, parent, bag, cover = row
        if bag is None:
            bag = 0
            for e in cover:
                bag |= edges[e]
        return node, parent, sorted(packed.bits(bag, vertices)), list(cover)

    def tree(root: Key, chosen: dict, covers: dict, name: Callable[[Key], str]) -> list[tuple]:
        """(node, parent, bag or null for that of the cover, cover), linked as ``frontier.trees_of`` links them."""
        nodes: dict[str, tuple[int | None, tuple[int, ...]]] = {}
        links: list[tuple[str, str]] = []
        waiting: list[tuple[str, Key, list[tuple[int, str]]]] = [("0", root, [])]
        while waiting:
            occ, key, owners = waiting.pop()
            if key in chosen:
                rank, kids = chosen[key]
                sep, cover = covers[key, rank]
                nodes[occ] = sep, cover
                for n, kid in enumerate(sorted(kids, key=name)):
                    waiting.append((f"{occ}.{n}", kid, [o for o in [*owners, (sep, occ)] if o[0] in kid[1]]))
            elif key[0]:
                nodes[occ] = None, key[0][:k]
                links += [(occ, owner) for _, owner in owners]
                if k == 1 and len(key[0]) == 2:
                    nodes[occ + "b"] = None, key[0][1:]
                    links.append((occ, occ + "b"))
            elif len(owners) == 2:
                links.append((owners[0][1], owners[1][1]))
        near: dict[str, list[str]] = {}
        for x, y in links:
            near.setdefault(x, []).append(y)
            near.setdefault(y, []).append(x)
        up: dict[str, str | None] = {"0": None}
        order = ["0"]
        for x in order:
            for y in near.get(x, ()):
                if y not in up:
                    up[y] = x
                    order.append(y)
        ids = {x: n for n, x in enumerate(sorted(nodes), 1)}
        return [(ids[x], ids.get(up[x]), *nodes[x]) for x in order]

    return run
