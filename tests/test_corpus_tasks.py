"""The corpus takes tasks by its rows, and gives each row once however often the tables repeat theirs."""

from hyperloom.operators import incidence


def test_corpus_rows_and_tasks(spark, tmp_path, monkeypatch):
    rows = [(o, s) for o in range(1, 60) for s in (o % 7, o % 5, o % 5, 3)] * 2
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o % 4) for o in range(1, 50)] * 2 + [(1, 9), (70, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(incidence, "TASK_ROWS", 10)
    frame = incidence.corpus(spark, str(tmp_path), "hs")
    got = [tuple(r) for r in frame.select("g", "e", "v").collect()]
    want = {(g, o, s) for o, s in rows if o < 50 for g in ((o % 4, 9) if o == 1 else (o % 4,))}
    assert len(got) == len(want) and set(got) == want
    assert frame.rdd.getNumPartitions() >= len(rows) // 10
