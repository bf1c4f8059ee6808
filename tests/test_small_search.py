"""Small graphs as rows are searched as by joins."""

import random
from itertools import combinations
from math import comb

from hyperloom.operators import frontier, packed, small_search


def test_places_lists_every_set_once():
    for n, k in ((1, 2), (4, 1), (5, 2), (6, 3)):
        want = [c for m in range(k, 0, -1) for c in sorted(combinations(range(n), m), key=lambda c: c[::-1])]
        assert [small_search.places(r, n, k) for r in range(sum(comb(n, m) for m in range(1, k + 1)))] == want


def test_decompose_equals_joins(spark, monkeypatch):
    """The same verdicts, numbers of subproblems and trees, over several blocks; random graphs, a clique that has no tree of width 2, a cycle, and pieces that do not touch."""
    rng, rows = random.Random(3), []
    for g in range(6):
        for e in range(1, rng.randint(4, 12)):
            rows += [(g, e, v) for v in rng.sample(range(9), rng.randint(2, 4))]
    rows += [(10, e, v) for e, p in enumerate(combinations(range(6), 2), 1) for v in p] + [(11, e, (e + d) % 9) for e in range(9) for d in (0, 1)]
    rows += [(12, e, v) for e, p in enumerate([(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6)], 1) for v in p]
    inc = spark.createDataFrame(rows, "g long, e long, v long")
    monkeypatch.setattr(frontier, "FIRST", 8)
    monkeypatch.setattr(frontier, "GROWTH", 4)
    sort = lambda frame: sorted((tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()), key=repr)
    calls = []
    monkeypatch.setattr(frontier, "_decompose_by_joins", lambda *a, f=frontier._decompose_by_joins: calls.append(1) or f(*a))
    got = [sort(f) for f in frontier.decompose(inc, 2)]
    assert not calls and {r[-1] for r in got[0]} == {"yes", "no"}
    monkeypatch.setattr(packed, "MOST_TRIED", 0)
    assert got == [sort(f) for f in frontier.decompose(inc, 2)] and calls
