"""Set and list expressions over vertex arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersect_keep(a, b) -> Column:
    """Elements of ``a`` that are in ``b``, in order and with repetitions."""
    return F.filter(a, lambda x: F.array_contains(b, x))


def except_keep(a, b) -> Column:
    """Elements of ``a`` that are not in ``b``, in order and with repetitions."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def is_subset(a, b) -> Column:
    """Every element of ``a`` is in ``b``; the empty list is in any."""
    return F.size(F.array_except(a, b)) == 0


def neighbours(a, b) -> Column:
    return F.arrays_overlap(a, b)


def vertex_set(vertices) -> Column:
    """Sorted distinct vertices: the exact key under which edges are equal."""
    return F.array_sort(F.array_distinct(vertices))


def connecting(separator, conn, component) -> Column:
    """The separator covers ``conn`` and touches the component."""
    return is_subset(conn, separator) & F.arrays_overlap(separator, component)


def balance_limit(size, factor: int = 2) -> Column:
    """Largest component that a balanced separator may leave: floor(size * (factor - 1) / factor)."""
    size = F.col(size) if isinstance(size, str) else size
    # In whole numbers: a division would round large sizes.
    scaled = size * (factor - 1)
    return ((scaled - F.pmod(scaled, F.lit(factor))) / factor).cast("long")


def decrease(n) -> Column:
    return F.greatest(F.col(n) - 1, F.lit(0))


def choose(n: Column, k: int) -> Column:
    """Number of subsets of k of n elements, as an expression: each step divides without a rest."""
    out = F.lit(1).cast("long")
    for i in range(k):
        out = F.call_function("div", out * (n - i), F.lit(i + 1)) if i else n.cast("long")
    return F.when(n >= k, out).otherwise(F.lit(0).cast("long"))


def combination_rank(positions: list[Column]) -> Column:
    """Rank from 0 of ascending positions (from 1) among all sets of as many, in colexicographic order."""
    return sum((choose(p - 1, k) for k, p in enumerate(positions[1:], 2)), choose(positions[0] - 1, 1))


def binomial(n: int, k: int) -> int:
    from math import comb

    return comb(n, k) if 0 <= k <= n else 0


def extended_binomial(n: int, k: int) -> int:
    """Number of subsets of 1 to k of n elements."""
    return sum(binomial(n, i) for i in range(1, k + 1))


def powerset(vertices) -> Column:
    """All subsets of an array, the empty one included, by folding each element into the subsets so far."""
    empty = F.array(F.expr("cast(array() as array<bigint>)"))
    return F.aggregate(vertices, empty, lambda acc, v: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, v))))


def fingerprint(vertices) -> Column:
    """Order-insensitive 64-bit fingerprint; equality tests use ``vertex_set``."""
    return F.aggregate(F.array_distinct(vertices), F.lit(0).cast("long"), lambda acc, v: acc.bitwiseXOR(F.xxhash64(v)))
