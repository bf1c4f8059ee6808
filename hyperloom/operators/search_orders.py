"""Orders of edges that follow from a sequential choice inside each graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.operators import search


def msc_order(inc: DataFrame, seed: int = 0) -> DataFrame:
    """(g, e, rank) in maximal-cardinality order: next comes an edge that meets most of those before it; each choice needs the one before, so a graph is one task."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        edges = {int(e): frozenset(map(int, vs)) for e, vs in zip(frame["e"], frame["vertices"], strict=True)}
        order = search.msc_order(edges, seed)
        return pd.DataFrame({"g": int(frame["g"].iloc[0]), "e": order, "rank": range(1, len(order) + 1)})

    lists = inc.groupBy("g", "e").agg(F.array_sort(F.collect_set("v")).alias("vertices"))
    return lists.groupBy("g").applyInPandas(one, "g long, e long, rank int")
