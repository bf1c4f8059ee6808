"""Every graph is decided, by every solver, as elimination orders tell."""

import random

from hyperloom.operators import packed, solvers
from hyperloom.plans import corpus_queries

SF = "/root/testdata/sf0.001"


def narrow(edges, k):
    """Whether some order of the vertices leaves each, with those that it is then linked to, within k edges."""
    vertices = frozenset().union(*edges.values())
    known = {}

    def within(bag, n):
        return not bag or (n > 0 and any(within(bag - vs, n - 1) for vs in edges.values() if min(bag) in vs))

    def rest(left):
        if left not in known:
            known[left] = not left or any(within({v} | linked(v, left), k) and rest(left - {v}) for v in left)
        return known[left]

    def linked(v, left):
        found, todo, seen = set(), [v], {v}
        while todo:
            at = todo.pop()
            for w in frozenset().union(*(vs for vs in edges.values() if at in vs)) - seen:
                seen.add(w)
                if w in left:
                    found.add(w)
                else:
                    todo.append(w)
        return found

    return rest(vertices)


def test_no_graph_stays_open(spark):
    graphs = {}
    for r in corpus_queries.incidence(spark, SF).collect():
        graphs.setdefault(r["g"], {}).setdefault(r["e"], set()).add(r["v"])
    want = {g: "yes" if narrow(edges, 2) else "no" for g, edges in graphs.items()}
    assert set(want.values()) == {"yes", "no"}
    for kind in ("global", "local", "hybrid", "cost", "det"):
        rows = corpus_queries.QUERIES[f"solve_{kind}_k2"](spark, SF).collect()
        assert {r["g"]: r["verdict"] for r in rows} == want and len(rows) == len(want), kind
        assert all((r["width"] in (1, 2)) == (r["verdict"] == "yes") and r["width"] == 1 or not narrow(graphs[r["g"]], 1) for r in rows), kind


def test_outcomes_of_large_graphs(spark, monkeypatch):
    h = corpus_queries.incidence(spark, SF).where("g < 20").cache()
    sort = lambda: sorted(map(tuple, solvers.outcomes(h, 2, "local").collect()))
    got = sort()
    monkeypatch.setattr(packed, "MOST", 30)
    assert got == sort()


def test_bound_changes_no_tree(monkeypatch):
    """The bound on the width only ends searches that find nothing: the same trees without it, for other widths and factors too."""
    rng = random.Random(5)
    graphs = [{e: frozenset(rng.sample(range(8), rng.randint(1, 4))) for e in range(1, rng.randint(4, 8))} for _ in range(40)]
    run = lambda: [solvers.rows(g, t) if (t := solvers.decompose(edges, k, kind, steps=None, factor=f)) else None for g, edges in enumerate(graphs) for kind in ("global", "local", "hybrid", "cost") for k, f in ((1, 2), (2, 2), (2, 3))]
    got = run()
    monkeypatch.setattr(solvers, "MOST_BOUNDED", 0)
    assert got == run() and None in got and any(got)
