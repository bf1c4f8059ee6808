"""The pipeline's stages on the small table."""

import importlib

import __spark_entry__

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 300
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")}


def test_stages_on_odd_rows_and_no_rows(spark, odd, none):
    """Nulls, empty and long texts, repeated rows, clashing column names and no n_chars; see the stages' docstrings."""
    pipeline = importlib.import_module("corpus_pipeline")
    clash = odd.selectExpr("*", "'a' AS toxicity", "1 AS quality", "1 AS features", "2 AS line_key", "3 AS other", "4 AS comp", "5 AS score", "6 AS rep")
    bare = none.selectExpr("doc_id", "text")
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, clash, SF)
        assert kept.columns == clash.columns, name
        rows = kept.collect()
        assert {3, 4, None} <= {r["doc_id"] for r in rows} or name == "quality classifier", name
        assert stage(spark, bare, SF).columns == ["doc_id", "text"] and stage(spark, bare, SF).count() == 0, name
    assert sorted({r["doc_id"] or 0 for r in pipeline.STAGES[3][1](spark, clash, SF).collect()}) == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    packed = pipeline.STAGES[-1][1](spark, clash, SF)
    assert packed.select("doc_id").where("piece = 0").count() == 11 and pipeline.STAGES[-1][1](spark, bare, SF).count() == 0


def test_near_duplicate_stage_keeps_other_texts_of_an_id(spark):
    """A row goes for its text: other rows of its id stay, of equal rows one stays."""
    pipeline = importlib.import_module("corpus_pipeline")
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, one), (5, one), (5, two), (None, one), (None, one), (7, two + " end"), (9, "x"), (9, "x"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = sorted(map(tuple, pipeline.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    assert left == sorted([(1, one), (5, two), (None, one), (None, one), (9, "x"), (4, None), (4, None)], key=str)
