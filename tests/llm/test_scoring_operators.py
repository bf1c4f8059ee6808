"""Toxicity and the quality classifier: held-out accuracy, segments, odd rows."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hyperloom.llm import quality_pu, queries, toxicity

SF = "/root/testdata/sf0.1"


def held_out(frame, label, threshold):
    labels = dict(duckdb.sql(f"select doc_id, {label} from '{SF}/labels.parquet'").fetchall())
    rows = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in frame.collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= s <= 1 and p == (s >= threshold) for _, s, p in rows)
    y, p = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    return float((y == p).mean()), float(p[y == 1].mean()), float(1 - p[y == 0].mean())


def test_toxicity_held_out(spark):
    accuracy, caught, spared = held_out(queries.op7_toxicity(spark, SF), "toxic", 0.5)
    assert accuracy > 0.97 and caught > 0.85 and spared > 0.98


def test_quality_held_out(spark):
    accuracy, kept, dropped = held_out(queries.op9_quality_classifier(spark, SF), "quality", 0.7)
    assert accuracy > 0.93 and kept > 0.95 and dropped > 0.8


def brute_segments(scores):
    """Maximal segments by the definition: best of the whole, then of what lies left and right of it."""
    n, best = len(scores), (0.0, 0, 0, 0)
    for i in range(n):
        total = 0.0
        for j in range(i, n):
            total += scores[j]
            if total > 0 and (total, -(j - i)) > (best[0], -best[3]):
                best = (total, i, j + 1, j - i)
    if best[0] <= 0:
        return []
    _, i, j, _ = best
    return brute_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(scores[j:])]


def test_segments_are_the_maximal_ones():
    rng = random.Random(1)
    for _ in range(200):
        scores = np.array([rng.choice([-3.1, -1.7, -0.6, 0.9, 2.3, 4.4]) + rng.random() / 100 for _ in range(rng.randrange(0, 14))])
        assert [(s, e) for s, e, _ in toxicity.segments(scores)] == brute_segments(scores)


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels)


def test_passages(spark, odd, none, model):
    text = "calm words here " * 30 + "you stupid idiot and pathetic loser " + "more calm words " * 30
    rows = toxicity.passages(spark.createDataFrame([(1, text), (2, "calm words " * 50)], "doc_id long, text string"), model).collect()
    assert [r["doc_id"] for r in rows] == [1] and "idiot" in rows[0]["passage"] and len(rows[0]["passage"]) < 60
    assert text.encode()[rows[0]["start"] : rows[0]["end"]].decode() == rows[0]["passage"]
    scored = odd.select("*", toxicity.score_column(model).alias("score")).collect()
    assert len(scored) == 11 and all(0 <= r["score"] < 0.5 for r in scored)
    assert none.select(toxicity.score_column(model)).count() == 0 and toxicity.passages(none, model).count() == 0


def test_toxicity_without_labels(spark, odd):
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert {r[0] for r in odd.select(toxicity.score_column(toxicity.fit(odd, labels))).collect()} == {model_zero()}


def model_zero():
    return float(toxicity.EMPTY.probability(np.zeros(1))[0])


def test_quality_odd_rows(spark, odd, none):
    table = quality_pu.feature_table(odd)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (9, 1, 0)], "doc_id long, quality int, toxic int")
    fitted = quality_pu.fit(table, labels)
    rows = table.select("doc_id", quality_pu.probability(fitted).alias("s")).collect()
    assert len(rows) == 11 and all(0 <= r["s"] <= 1 for r in rows)
    direct = odd.select("doc_id", quality_pu.score_column(fitted).alias("s")).collect()
    key = lambda r: (str(r[0]), round(r[1], 5))
    assert sorted(map(key, rows)) == sorted(map(key, direct))
    empty = quality_pu.fit(quality_pu.feature_table(none), labels)
    assert quality_pu.feature_table(none).select(quality_pu.probability(empty)).count() == 0


def test_features_do_not_depend_on_the_batch():
    texts = ["One two three.\nfour five!", None, "", "A | b | c", "x x x x x x", "Ünï 漢字 9"]
    whole = quality_pu.features(pa.array(texts))
    assert np.allclose(whole, np.concatenate([quality_pu.features(pa.array([t], pa.string())) for t in texts]))
    assert whole.shape == (6, quality_pu.N_FEATURES)


def test_class_prior():
    trusted = np.array([0.0] * 10 + [100.0] * 10)
    unlabelled = np.array([300.0] * 10 + [700.0] * 10) * 100
    assert 0.65 < quality_pu.class_prior(trusted * 1000, unlabelled) < 0.76
