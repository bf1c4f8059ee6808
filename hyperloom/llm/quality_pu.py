"""Quality classifier learned from trusted positives and unlabelled text.

Texts become a vector of style features. A first classifier tells trusted positives from unlabelled texts; the share of positives among the unlabelled
(the class prior) is the smallest ratio, over score thresholds, of the share of all unlabelled texts above it to the share of trusted ones above it,
with a confidence margin. The final classifier minimises the non-negative unbiased risk: prior * E+[loss(g)] + max(0, Eu[loss(-g)] -
prior * E+[loss(-g)]), by gradient steps that turn back where the second term falls below zero. Labels of bad texts are never used.

Fitting reads at most ``most_labelled`` trusted and ``most_unlabelled`` unlabelled texts (smallest hashes of their ids); the prior is
estimated over all texts. Null and empty texts have the features of no words. Without trusted positives, or without unlabelled texts, every score is 0.5.
Repeated rows get equal scores, and other columns pass unchanged or are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.storage import materialize
from hyperloom.llm.textvec import SPACED, Alphabet, Words, blocks, grams, utf8

MOST_LABELLED, MOST_UNLABELLED = 20_000, 40_000
RIDGE, STEPS, RATE = 1e-4, 600, 0.05
LINES = Alphabet(b"\n", lower=False)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


CLASSES = {
    "upper": _class(bytes(range(65, 91))), "lower": _class(bytes(range(97, 123))), "digit": _class(b"0123456789"), "symbol": _class(b"#*$%&<>"), "bar": _class(b"|"), "stop": _class(b".?"),
    "bang": _class(b"!"), "comma": _class(b",;:"), "other": _class(b"_=+~^@\\/{}[]()`\"'-"), "high": _class(bytes(range(192, 256))),
}


def distinct_share(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct values over values of each slice; 1 for empty ones."""
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(count)) / np.maximum(count, 1) + (count == 0)


def features(column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    parts = [_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES), np.float32)


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    size = np.diff(offsets)
    share = {}
    for name, table in CLASSES.items():
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=sums[1:])
        share[name] = np.diff(sums[offsets]) / np.maximum(size, 1)
    words, lines = Words(data, offsets, SPACED), Words(data, offsets, LINES)
    n, m = words.counts(), lines.counts()
    length = np.concatenate([[0], np.cumsum(words.end - words.start)])[words.first]
    mean_word = np.diff(length) / np.maximum(n, 1)
    size_one = np.concatenate([[0], np.cumsum(words.end - words.start == 1)])[words.first]
    single = np.diff(size_one) / np.maximum(n, 1)
    h = words.hash
    again = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        again[2:] = np.cumsum(h[1:] == h[:-1])
    again = np.diff(again[words.first]) / np.maximum(n, 1)
    g = grams(h, 3)
    n3 = np.maximum(n - 2, 0)
    keep = np.ones(len(h), bool)  # windows that stay inside their text
    for k in (1, 2):
        at = words.first[1:] - k
        keep[at[(at >= words.first[:-1])]] = False
    g = g[keep[: len(g)]]
    first3 = np.concatenate([[0], np.cumsum(n3)])
    fresh3 = distinct_share(g, first3)
    fresh = distinct_share(h, words.first)
    fresh_lines = distinct_share(lines.hash, lines.first)
    log = lambda x: np.log(x + 2e-3)
    columns = [
        *[log(share[c]) for c in ("upper", "digit", "symbol", "bar", "bang", "other", "stop", "comma")], share["lower"], share["high"], log(share["upper"] / (share["lower"] + 0.01)),
        np.log1p(n), np.log1p(np.abs(mean_word - 4.5)), mean_word.clip(0, 30) / 10, log(again), fresh3, log(1 - fresh3), fresh * np.log1p(n), fresh_lines, log(1 - fresh_lines),
        np.log1p(n / np.maximum(m, 1)), np.log(single + 2e-3), (n == 0).astype(float), (n < 20).astype(float),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


N_FEATURES = 24


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last one is the intercept
    prior: float
    fitted: bool = True

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return z @ self.weights[:-1] + self.weights[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def descend(slope, size: int) -> np.ndarray:
    """Adam on a full-batch gradient."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, STEPS + 1):
        g = slope(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_contrast(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Trusted against unlabelled, both classes weighing the same."""

    def slope(w: np.ndarray) -> np.ndarray:
        return -p.T @ (1 - sigmoid(p @ w)) / len(p) + u.T @ sigmoid(u @ w) / len(u) + RIDGE * w

    return descend(slope, p.shape[1])


def fit_nonnegative(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Non-negative unbiased risk with the logistic loss."""

    def slope(w: np.ndarray) -> np.ndarray:
        gp, gu = p @ w, u @ w
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        inner = u.T @ sigmoid(gu) / len(u) - prior * (p.T @ sigmoid(gp)) / len(p)
        outer = -prior * (p.T @ (1 - sigmoid(gp))) / len(p)
        return (outer + inner if negative >= 0 else -inner) + RIDGE * w

    return descend(slope, p.shape[1])


def class_prior(trusted: np.ndarray, unlabelled: np.ndarray) -> float:
    """From counts by score bin, lowest first: the smallest upper bound of (share of unlabelled above) / (share of trusted above)."""
    n_p, n_u = trusted.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    above_p, above_u = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (trusted, unlabelled))
    # A quarter of the margin that holds for all thresholds at once: a prior that is too high spares bad texts.
    margin = 0.25 * (np.sqrt(np.log(40.0) / (2 * n_u)) + np.sqrt(np.log(40.0) / (2 * n_p)))
    ok = above_p > max(0.05, margin)
    return float(np.clip(((above_u + margin) / np.maximum(above_p, 1e-9))[ok].min(), 0.05, 0.99))


def feature_column(column: str = "text") -> Column:
    """The features of a text column as an array."""

    @F.arrow_udf("array<float>")
    def vector(texts: pa.Array) -> pa.Array:
        x = features(texts)
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES, x.ravel())

    return vector(F.col(column))


def feature_table(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the features of each text, written to the shared folder."""
    return materialize(docs.select(F.col(ident).alias("doc_id"), feature_column(text).alias("x")), "quality-features")


def margin_column(model: QualityModel, column: str = "x") -> Column:
    """Linear margin of a feature array as an expression in Spark."""
    mean, spread, weights = (F.array(*[F.lit(float(v)) for v in a]) for a in (model.mean, model.spread, model.weights[:-1]))
    z = F.zip_with(F.zip_with(column, mean, lambda a, b: a - b), spread, lambda a, b: F.greatest(F.lit(-6.0), F.least(F.lit(6.0), a / b)))
    return F.aggregate(F.zip_with(z, weights, lambda a, b: a * b), F.lit(float(model.weights[-1])), lambda a, b: a + b)


def fit(table: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_unlabelled: int = MOST_UNLABELLED) -> QualityModel:
    """``table`` is a feature table. Trusted: quality 1 where crc32(doc_id) mod 4 is not 2. Unlabelled: texts without a label row."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    kinds = table.join(known.withColumn("known", F.lit(1)), "doc_id", "left").withColumn(
        "kind", F.when((F.col("quality") == 1) & fold, "trusted").when(F.col("known").isNull(), "unlabelled")
    )
    kinds = kinds.where("kind IS NOT NULL").select("doc_id", "kind", "x")
    draw = lambda kind, most: kinds.where(F.col("kind") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").select("x").limit(most).toArrow()["x"]
    flat = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(float)
    p, u = flat(draw("trusted", most_labelled)), flat(draw("unlabelled", most_unlabelled))
    none = QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), 0.5, False)
    if not len(p) or not len(u):
        return none
    both = np.concatenate([p, u])
    mean, spread = both.mean(0), both.std(0) + 1e-3
    ready = lambda a: np.hstack([np.clip((a - mean) / spread, -6, 6), np.ones((len(a), 1))])
    first = QualityModel(mean, spread, fit_contrast(ready(p), ready(u)), 0.5)
    bins = kinds.groupBy("kind", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(199.0), margin_column(first) * 20 + 100))).alias("bin")).agg(F.count("*").alias("n")).collect()
    counts = {k: np.zeros(200) for k in ("trusted", "unlabelled")}
    for r in bins:
        counts[r["kind"]][int(r["bin"])] += r["n"]
    prior = class_prior(counts["trusted"], counts["unlabelled"])
    return QualityModel(mean, spread, fit_nonnegative(ready(p), ready(u), prior), prior)


def probability(model: QualityModel, column: str = "x") -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), margin_column(model, column)))))


def score_column(model: QualityModel, column: str = "text"):
    """The score straight from a text column."""

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        return pa.array(model.probability(features(texts)).astype(float))

    return quality(F.col(column))
