import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.llm import gru_lm, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [*(w.lower() for w in WORD.findall((text or "").encode())), b""]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def step(net, symbol, h):
    """One step of the unit, number by number."""
    size, x, u = net.hidden, net.inputs[symbol].astype(float), h @ net.state.astype(float)
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    z, r = sigmoid(x[:size] + u[:size]), sigmoid(x[size : 2 * size] + u[size : 2 * size])
    new = np.tanh(x[2 * size :] + r * (u[2 * size :] + net.new_bias))
    return (1 - z) * new + z * h


def factor(net, h, symbol):
    """Natural logarithm of the factors that the network gives a symbol after state h."""
    share = lambda w, b, k: float((h @ w + b)[k] - np.log(np.exp(h @ w + b).sum()))
    if symbol >= gru_lm.NEURAL:
        return share(net.classes.astype(float), net.class_bias, symbol - gru_lm.NEURAL + gru_lm.NEURAL // gru_lm.CLASS)
    group, member = divmod(symbol, gru_lm.CLASS)
    return share(net.classes.astype(float), net.class_bias, group) + share(net.members[group].astype(float), net.member_bias[group], member)


def plain_score(model, counts, text):
    """log10 probability of a text, token by token, from the whole table of counts."""
    known, net, total = model.vocabulary, model.network, 0.0
    h, last = np.zeros(net.hidden), gru_lm.NEURAL + gru_lm.ENDINGS
    neural = {w: k for k, w in enumerate(known.words[: gru_lm.NEURAL])}
    outside = Counter()
    for w, c in counts.items():
        if w not in neural:
            outside[gru_lm.ending(w), "c"] += c
            outside[gru_lm.ending(w), "n"] += 1
    for w in words(text):
        h = step(net, last, h)
        last = neural.get(w, gru_lm.NEURAL + gru_lm.ending(w))
        total += factor(net, h, last) / math.log(10)
        if w not in neural:
            k = gru_lm.ending(w)
            total += math.log10((counts.get(w, 0) + 0.5) / (outside[k, "c"] + 0.5 * (outside[k, "n"] + 1)))
    return total


@pytest.fixture(scope="module")
def scored(spark):
    rows = queries.QUERIES["op13_gru_lm"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    return rows, texts


def test_counts_and_base_scores(scored):
    rows, texts = scored
    counts = Counter(w for i, t in texts.items() if not held(i) for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        mine = words(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(mine), sum(counts[w] > 0 for w in mine), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in mine), rel=1e-9)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    out = queries.QUERIES["op13_gru_lm"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in out) > 0.98 * sum(r["base_score"] for r in out) and all(r["score"] < 0 for r in out)


def test_scores_equal_plain(spark, monkeypatch):
    """The whole score of texts over many windows, known, rare, and unknown tokens, for a trained model."""
    monkeypatch.setattr(gru_lm, "KNOWN", 3000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = gru_lm.fit(docs, F.col("doc_id") % 3 != 0)
    frame, n_tokens, n_known, base, score = gru_lm.score(docs, model)
    counts = {bytes(r["word"]): r["c"] for r in model.counts.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(counts) > 3000
    for r in sorted(frame.collect(), key=lambda r: r[n_tokens])[::9]:
        if r[n_tokens] < 3000:
            assert r[score] == pytest.approx(plain_score(model, counts, texts[r["doc_id"]]), rel=1e-4, abs=1e-3)


def test_every_training_text_trains_the_network(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for frame, training in ((docs, F.col("doc_id") % 3 != 0), (odd.select("doc_id", "text"), F.lit(True))):
        model = gru_lm.fit(frame, training)
        assert model.trained == model.vocabulary.total > 0


def vocabulary():
    some = [f"w{k}".encode() for k in range(3000)]
    counts = np.arange(3000, 0, -1)
    totals, distinct = np.zeros(gru_lm.ENDINGS), np.zeros(gru_lm.ENDINGS)
    for w, c in zip(some[gru_lm.NEURAL :], counts[gru_lm.NEURAL :], strict=True):
        totals[gru_lm.ending(w)] += c
        distinct[gru_lm.ending(w)] += 1
    return gru_lm.Vocabulary(some, counts, int(counts.sum()), 3000, totals, distinct)


def test_probabilities_sum_to_one():
    known = vocabulary()
    net = gru_lm.Network.start(known)
    states = np.random.default_rng(1).normal(size=(3, net.hidden)).astype(np.float32)
    every = np.arange(gru_lm.NEURAL + gru_lm.ENDINGS)
    for h in states:
        assert np.exp(net.log_probabilities(np.repeat(h[None], len(every), axis=0), every)).sum() == pytest.approx(1, abs=1e-4)
    mass = known.ending_mass()
    within = Counter()
    for k in range(gru_lm.NEURAL, 3000):
        within[known.symbol[k]] += 10 ** known.within[k]
    for s, share in within.items():
        assert share + 0.5 / mass[s - gru_lm.NEURAL] == pytest.approx(1)


def test_gradients_equal_differences():
    net = gru_lm.Network.start(vocabulary(), hidden=5)
    rng = np.random.default_rng(2)
    given = rng.integers(0, gru_lm.NEURAL + gru_lm.ENDINGS, (6, 3)).astype(np.int32)
    wanted = rng.integers(0, gru_lm.NEURAL + gru_lm.ENDINGS, 18).astype(np.int32)
    keep = np.ones((6, 3), np.float32)
    keep[2, 1] = keep[0] = 0

    def loss(vector):
        other = gru_lm.Network(vector, 5)
        states, _ = other.forward(given, keep, np.ones((3, 5), np.float32))
        return -float(other.log_probabilities(states.reshape(-1, 5), wanted).astype(float).sum())

    grad, memo, d_states = net.like(), [], np.zeros((18, 5), np.float32)
    states, _ = net.forward(given, keep, np.ones((3, 5), np.float32), memo)
    net.log_probabilities(states.reshape(-1, 5), wanted, grad, d_states)
    net.backward(given, keep, memo, d_states.reshape(6, 3, 5), grad)
    large = np.argsort(-np.abs(grad.vector))[:: 40][:60]
    for k in large:
        up, down = net.vector.copy(), net.vector.copy()
        up[k] += 0.02
        down[k] -= 0.02
        assert (loss(up) - loss(down)) / 0.04 == pytest.approx(grad.vector[k], rel=0.05, abs=2e-3)


def test_odd_rows(spark, odd, none):
    """Nulls, blanks, repeats, long texts, clashing names; nothing to train on; no rows."""
    docs = odd.withColumnRenamed("__id", "row").selectExpr("*", "lang AS score", "lang AS word", "lang AS `0`")
    model = gru_lm.fit(docs, F.lit(True))
    frame, n_tokens, n_known, base, score = gru_lm.score(docs, model)
    rows = frame.collect()
    assert len(rows) == docs.count() and set(docs.columns) - {"text"} <= set(frame.columns) and len(set(frame.columns)) == len(frame.columns)
    by = {r["doc_id"]: r for r in rows}
    assert by[8][n_tokens] == by[8][n_known] == 30_001 and by[3][n_tokens] == by[4][n_tokens] == by[5][n_tokens] == 1 and by[3]["row"] is None
    assert len({(r[base], r[score]) for r in rows if r["doc_id"] == 7}) == 1 and all(math.isfinite(r[score]) and r[score] <= 0 for r in rows)
    unknown = gru_lm.score(docs, gru_lm.fit(docs, F.lit(False)))
    assert all(r[unknown[2]] == 0 and r[unknown[3]] == 0 and math.isfinite(r[unknown[4]]) for r in unknown[0].collect())
    assert gru_lm.score(none, gru_lm.fit(none, F.lit(True)))[0].collect() == []
