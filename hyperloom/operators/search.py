"""Search helpers for one small graph inside a task: plain sets, no Spark."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

Edges = dict[int, frozenset[int]]


def parts(edges: Edges, specials: list, separator: frozenset[int]) -> list[tuple[Edges, list]]:
    """Components without the separator's vertices, by smallest member; edges inside the separator are in none, specials inside it stand alone."""
    items = [(("e", k), vs - separator) for k, vs in sorted(edges.items())] + [(("s", k), s[1] - separator) for k, s in enumerate(specials)]
    groups: list[tuple[set, set]] = []
    for name, rest in items:
        if not rest:
            if name[0] == "s":
                groups.append(({name}, set()))
            continue
        names, verts, keep = {name}, set(rest), []
        for g in groups:
            if g[1] & rest:
                names |= g[0]
                verts |= g[1]
            else:
                keep.append(g)
        groups = [*keep, (names, verts)]
    made = [({k: edges[k] for t, k in sorted(n) if t == "e"}, [specials[k] for t, k in sorted(n) if t == "s"]) for n, _ in groups]
    return sorted(made, key=lambda p: (min(p[0], default=1 << 62), len(p[1])))


def combos(ids: list[int], k: int, smaller: bool) -> Iterator[tuple[int, ...]]:
    """Sets of k ids, and of fewer after them if ``smaller``."""
    k = min(k, len(ids))
    return chain.from_iterable(combinations(ids, n) for n in (range(k, 0, -1) if smaller else [k]))


def covers(edges: Edges, conn: frozenset[int], k: int, inner: set[int]) -> Iterator[tuple[int, ...]]:
    """Sets of at most k edges that cover ``conn`` and use an edge of ``inner``, those that cover most first."""
    useful = sorted(edges, key=lambda e: (-len(edges[e] & conn), e))
    for n in range(1, k + 1):
        for chosen in combinations(useful, n):
            if conn <= frozenset().union(*(edges[e] for e in chosen)) and (set(chosen) & inner):
                yield chosen


def subedges(edges: Edges, e: int, k: int) -> list[frozenset[int]]:
    """Proper subsets of edge e that it shares with unions of at most k other edges, large first; the empty one last."""
    base = sorted({edges[e] & f for x, f in edges.items() if x != e and edges[e] & f and not edges[e] <= f}, key=lambda s: (-len(s), sorted(s)))
    found = set()
    for n in range(1, min(k, len(base)) + 1):
        for chosen in combinations(base, n):
            union = frozenset().union(*chosen)
            for size in range(len(union), 0, -1):
                found |= {frozenset(c) for c in combinations(sorted(union), size)}
    return [*sorted(found - {edges[e]}, key=lambda s: (-len(s), sorted(s))), frozenset()]


def closure(edges: Edges, k: int) -> list[tuple[int, frozenset[int]]]:
    """(edge, subset) of all edges and of their intersections with unions of at most k others, each vertex set once."""
    seen, out = set(), []
    for e in sorted(edges):
        for vs in [edges[e], *subedges(edges, e, k)]:
            if vs and vs not in seen:
                seen.add(vs)
                out.append((e, vs))
    return out


def msc_order(edges: Edges, seed: int = 0) -> list[int]:
    """Maximal-cardinality order: next comes an edge that meets most of those before it; the seed picks the first, ids break ties."""
    left = sorted(edges)
    if not left:
        return []
    order = [left.pop(seed % len(left))]
    while left:
        best = max(left, key=lambda e: (sum(bool(edges[e] & edges[o]) for o in order), -e))
        left.remove(best)
        order.append(best)
    return order


def gyo_log(edges: Edges) -> tuple[Edges, list[tuple]]:
    """The residue, and the steps ('edge', id, vertices, parent) and ('vertex', v, id, vertices before) in order."""
    edges, log = dict(edges), []
    while True:
        before = len(log)
        for e in sorted(edges):
            above = [f for f in edges if f != e and edges[e] <= edges[f] and (edges[e] != edges[f] or f > e)]
            if above:
                log.append(("edge", e, edges[e], max(above)))
                del edges[e]
        count: dict[int, list[int]] = {}
        for e, vs in edges.items():
            for v in vs:
                count.setdefault(v, []).append(e)
        for v, owners in sorted(count.items()):
            if len(owners) == 1:
                e = owners[0]
                log.append(("vertex", v, e, edges[e]))
                edges[e] -= {v}
                if not edges[e]:
                    del edges[e]
        if len(log) == before:
            return edges, log
