"""Toxic passages by maximum-scoring segments.

Training gives each word and each stem (a word's first bytes, for inflected forms) a log-odds score with an informative Dirichlet prior: the numbers of toxic
and of other training texts with it, smoothed by its share of both. A word of a text scores as it or its stem does, whichever is higher; words without a
significant score share one small negative score. A linear scan finds every
maximal segment of a text's word scores. Under the background (texts that are not toxic) the best segment's score follows an extreme-value law,
whose decay solves sum p(s) exp(lambda s) = 1; it turns the segment scores of a text, by the statistic of the sum of its best
segments, into evidence that does not depend on the text's length. A logistic curve of the evidence is the score.

Fitting reads at most ``most_labelled`` labelled texts (those with the smallest hash of their id) and keeps at most ``most_words``
significant words. Null and empty texts have no words and get the score of no evidence. Without labels of both classes every score is 0.
Rows are scored one by one; repeated rows get equal scores, and other columns pass unchanged or are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.textvec import LETTERS, Words, blocks, utf8

MOST_LABELLED, MOST_WORDS = 40_000, 65_536
#: The prior weighs this share of all counts, so that a word's absence from one side is weak evidence if the word is rare.
PRIOR_SHARE, LEAST_Z, LEAST_COUNT, STEM_BYTES = 0.05, 3.0, 4, 4
COMMON_SCORE, TOP_SCORE = -0.15, 6.0
MOST_SEGMENTS, MOST_EVIDENCE = 8, 400.0


@dataclass(frozen=True)
class ToxicityModel:
    keys: np.ndarray  # sorted word hashes
    scores: np.ndarray
    decay: float
    scale: float
    slope: float
    intercept: float

    def word_scores(self, words: Words) -> np.ndarray:
        if len(self.keys) == 0 or len(words.hash) == 0:
            return np.full(len(words.hash), COMMON_SCORE)
        found = []
        for hashes in (words.hash, words.stems(STEM_BYTES)):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            found.append(np.where(self.keys[at] == hashes, self.scores[at], -np.inf))
        best = np.maximum(*found)
        return np.where(np.isfinite(best), best, COMMON_SCORE)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.intercept, -40, 40)))


EMPTY = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, 0.0, -40.0)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order; linear in the number of positive scores."""
    before = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    for k in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = k, k + 1, before[k], before[k + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, float(high - low)) for s, e, low, high in found]


def evidence(scores: list[float], words: int, decay: float, scale: float) -> float:
    """-ln p of the best sums of segment scores among the r best, r up to MOST_SEGMENTS."""
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True)[:MOST_SEGMENTS], 1):
        total += decay * s - math.log(max(scale * words, math.e))
        if total <= 0:
            continue
        best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
    return min(best, MOST_EVIDENCE)


def evidence_of(column: pa.Array, model: ToxicityModel) -> np.ndarray:
    data, offsets = utf8(column)
    out = np.zeros(len(offsets) - 1)
    for i, j in blocks(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], LETTERS)
        scores = model.word_scores(words)
        hits = np.concatenate([[0], np.cumsum(scores > 0)])[words.first]
        for d in np.flatnonzero(np.diff(hits)).tolist():
            own = scores[words.first[d] : words.first[d + 1]]
            out[i + d] = evidence([s for _, _, s in segments(own)], len(own), model.decay, model.scale)
    return out


def training_labels(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """At most ``most`` rows (doc_id, toxic) of the learning folds: crc32(doc_id) mod 5 is not 0."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most)


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", most_labelled: int = MOST_LABELLED, most_words: int = MOST_WORDS) -> ToxicityModel:
    # At most ``most_labelled`` rows of two numbers, so the broadcast is bounded.
    chosen = F.broadcast(training_labels(labels, most_labelled).select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic")))
    sample = docs.select(F.col(ident).alias("__id"), F.col(text).alias("__text")).join(chosen, "__id").select("__text", "__toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in blocks(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], LETTERS)
                owner = np.tile(np.repeat(np.arange(i, j), words.counts()), 2)
                both = np.concatenate([words.hash, words.stems(STEM_BYTES)])
                order = np.lexsort((owner, both))
                both, owner = both[order], owner[order]
                new = np.ones(len(both), bool)
                new[1:] = (both[1:] != both[:-1]) | (owner[1:] != owner[:-1])  # once for each text
                keys, at = np.unique(both[new], return_inverse=True)
                bad = np.bincount(at, weights=toxic[owner[new]], minlength=len(keys)).astype(np.int64)
                total = np.bincount(at, minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bad), pa.array(total - bad)], names=["word", "bad", "good"])

    counts = sample.mapInArrow(count, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = counts.persist()
    try:
        bad_all, good_all = counts.agg(F.sum("bad"), F.sum("good")).first()
        if not bad_all or not good_all:
            return EMPTY
        weight = PRIOR_SHARE * (bad_all + good_all)
        share = (F.col("bad") + F.col("good")) * PRIOR_SHARE
        odds = lambda c, n: F.log((F.col(c) + share) / (n + weight - F.col(c) - share))
        scored = counts.where(F.col("bad") + F.col("good") >= LEAST_COUNT).select(
            "word", "bad", "good", share.alias("share"), (odds("bad", bad_all) - odds("good", good_all)).alias("delta"),
            F.sqrt(1 / (F.col("bad") + share) + 1 / (F.col("good") + share)).alias("spread"),
        )
        top = scored.where(F.abs(F.col("delta") / F.col("spread")) >= LEAST_Z).orderBy(F.desc(F.abs(F.col("delta") / F.col("spread"))), "word").limit(most_words).collect()
    finally:
        counts.unpersist()
    keys = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    scores = np.clip([r["delta"] for r in top], -TOP_SCORE, TOP_SCORE) if top else np.zeros(0)
    back = np.array([(r["good"] + r["share"]) / (good_all + weight) for r in top])
    order = np.argsort(keys)
    model = ToxicityModel(keys[order], scores[order], decay_rate(scores, back), 1.0, 0.0, 0.0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(evidence_of(batch.column(0), model)), batch.column(1)], names=["evidence", "toxic"])

    # At most ``most_labelled`` pairs, rounded and counted.
    seen = sample.mapInArrow(weigh, "evidence double, toxic int").groupBy(F.round("evidence", 1).alias("evidence"), "toxic").agg(F.count("*").alias("n")).collect()
    x, y, n = (np.array([r[c] for r in seen], float) for c in ("evidence", "toxic", "n"))
    slope, intercept = logistic(np.log1p(x), y, n)
    return ToxicityModel(model.keys, model.scores, model.decay, model.scale, slope, intercept)


def decay_rate(scores: np.ndarray, probability: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the background; 1 where there is none."""
    rest = max(1e-9, 1.0 - probability.sum())
    excess = lambda v: float((probability * np.exp(v * scores)).sum() + rest * math.exp(v * COMMON_SCORE) - 1)
    low, high = 1e-6, 1.0
    if not len(scores) or scores.max() <= 0 or excess(low) >= 0:
        return 1.0
    while excess(high) < 0 and high < 50:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        slope = design.T @ (n * (y - p)) - 1e-3 * w
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score_column(model: ToxicityModel, column: str = "text"):
    """The score of a text column as a column expression."""

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        return pa.array(model.probability(evidence_of(texts, model)))

    return toxicity(F.col(column))


def passages(docs: DataFrame, model: ToxicityModel, ident: str = "doc_id", text: str = "text", least_evidence: float = 5.0) -> DataFrame:
    """(doc_id, start, end, passage, segment_score, evidence): every significant passage, in bytes of the UTF-8 text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            take, rows = [], []
            for i, j in blocks(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], LETTERS)
                scores = model.word_scores(words)
                for d in range(j - i):
                    lo, hi = words.first[d], words.first[d + 1]
                    for s, e, value in segments(scores[lo:hi]):
                        strength = evidence([value], int(hi - lo), model.decay, model.scale)
                        if strength >= least_evidence:
                            a, b = int(words.start[lo + s]), int(words.end[lo + e - 1])
                            begin = int(offsets[i + d] - offsets[i])
                            take.append(i + d)
                            rows.append((a - begin, b - begin, words.data[a:b].tobytes().decode("utf-8", "replace"), value, strength))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "start", "end", "passage", "segment_score", "evidence"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(run, f"doc_id {kind}, start long, end long, passage string, segment_score double, evidence double")
