"""Log-likelihood of whole texts under a gated recurrent language model.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end. Counts over all training texts give every token's base probability
(c + 0.5) / (N + 0.5 * (V + 1)). The model reads a text token by token with a gated recurrent unit and predicts the next one in two factors: its class, then the token
within the class. The ``NEURAL`` most frequent tokens form classes of ``CLASS`` tokens each, by rank, with a softmax within the class; all others
fall into ``ENDINGS`` classes by a hash of their last three bytes, and within these follow their counts ((c + 0.5) / (n + 0.5 * (v + 1)) with the class's sums), where one share
is left to unknown tokens. So every factor sums to one, and no token is without probability.

Everything is numpy inside tasks. Training is truncated backpropagation over windows of ``WINDOW`` steps with the state carried from window to window of a text. In each of a few
rounds every partition trains from the same parameters on the texts of its own part, and the parameters are averaged by tokens in blocks, so that the driver gets one
set of parameters, whatever the number of partitions. Word counts and recurrent training cover all training texts: each round takes its share of them (by hash), and every text falls to
one round. Scoring carries the state over the windows of a whole text, many texts side by side in lanes.

Broadcast are the parameters and at most ``KNOWN`` of the most frequent tokens of at most 64 bytes with their counts; the counts of all rarer tokens reach their texts by a join.

Null and empty texts are one end token. Every row is scored by itself, repeats and rows without an id too. Without training texts all tokens are unknown. Columns other than the text
pass unchanged, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.llm.storage import fresh, materialize

NEURAL, CLASS, ENDINGS, KNOWN = 2048, 64, 64, 1 << 16
HIDDEN, WINDOW = 24, 32
#: Sixteenths of the training texts, by hash, that each round trains on; together all of them.
ROUNDS = (range(5), range(5, 10), range(10, 16))
TRAIN_LANES, SCORE_LANES = 256, 256
RATE = 0.08
#: Tokens laid out in lanes at once.
TRAIN_TOKENS, SCORE_TOKENS = 1 << 20, 1 << 22
#: Training cuts texts into pieces of so many tokens, the later ones from a fresh state, so that one long text does not fill few lanes; scoring does not.
TRAIN_PIECE = 4096
#: Different words that a task counts before it gives them out.
MOST_COUNTED = 400_000
#: Blocks that parameters are averaged in.
BLOCKS = 128
_START = NEURAL + ENDINGS
_LN10 = float(np.log(10.0))


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


#: The same in SQL, of the binary column ``word``.
ENDING_SQL = f"CAST(crc32(CASE WHEN octet_length(word) <= 3 THEN word ELSE substring(word, octet_length(word) - 2, 3) END) % {ENDINGS} AS INT)"


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words, then the end, which is the empty word."""
    return [*(text or b"").lower().split(), b""]


class _Ranks(dict):
    """-1 for what is not there, without being added."""

    def __missing__(self, _: bytes) -> int:
        return -1


@dataclass
class Vocabulary:
    """The known tokens by rank, with counts, and sums over all training tokens."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    ending_total: np.ndarray
    ending_distinct: np.ndarray

    def __post_init__(self) -> None:
        self.rank = _Ranks(zip(self.words, range(len(self.words)), strict=True))
        self.symbol = np.array([k if k < NEURAL else NEURAL + ending(w) for k, w in enumerate(self.words)], np.int32)
        self.base = np.log10((self.counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))
        # Within its class: nothing for neural tokens, whose factor the model gives.
        by_count = np.log10((self.counts + 0.5) / self.ending_mass()[np.maximum(self.symbol - NEURAL, 0)]) if len(self.words) else np.zeros(0)
        self.within = np.where(self.symbol < NEURAL, 0.0, by_count)

    def ending_mass(self) -> np.ndarray:
        return self.ending_total + 0.5 * (self.ending_distinct + 1)

    def encode(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, Counter]:
        """Ranks (-1: not known), symbols, and the number of each token that is not known."""
        words = tokens(text)
        ranks = np.fromiter(map(self.rank.__getitem__, words), np.int32, len(words))
        symbols = self.symbol[ranks] if len(self.symbol) else np.zeros(len(words), np.int32)
        far = np.flatnonzero(ranks < 0)
        rare = [words[i] for i in far]
        symbols[far] = [NEURAL + ending(w) for w in rare]
        return ranks, symbols, Counter(rare)


class Network:
    """Parameters as one vector, with views of its parts."""

    def __init__(self, vector: np.ndarray | None = None, hidden: int = HIDDEN):
        shapes = {
            "inputs": (_START + 1, 3 * hidden), "state": (hidden, 3 * hidden), "new_bias": (hidden,), "classes": (hidden, NEURAL // CLASS + ENDINGS), "class_bias": (NEURAL // CLASS + ENDINGS,),
            "members": (NEURAL // CLASS, hidden, CLASS), "member_bias": (NEURAL // CLASS, CLASS),
        }
        sizes = [int(np.prod(s)) for s in shapes.values()]
        self.hidden = hidden
        self.vector = np.zeros(sum(sizes), np.float32) if vector is None else vector.astype(np.float32)
        for (name, shape), part in zip(shapes.items(), np.split(self.vector, np.cumsum(sizes)[:-1]), strict=True):
            setattr(self, name, part.reshape(shape))

    @classmethod
    def start(cls, vocabulary: Vocabulary, hidden: int = HIDDEN, seed: int = 7) -> Network:
        """Small random weights; biases that give every token its share of the training tokens."""
        net, rng = cls(hidden=hidden), np.random.default_rng(seed)
        net.inputs[:] = rng.normal(0, 0.1, net.inputs.shape)
        net.inputs[:, :hidden] += 1.0  # keep most of the state at first
        net.state[:] = rng.normal(0, 0.5 / hidden**0.5, net.state.shape)
        net.classes[:] = rng.normal(0, 0.1, net.classes.shape)
        net.members[:] = rng.normal(0, 0.1, net.members.shape)
        mass = np.zeros(NEURAL)
        mass[: min(NEURAL, len(vocabulary.counts))] = vocabulary.counts[:NEURAL]
        mass = mass.reshape(-1, CLASS)
        absent = -1e4  # a member or a class that does not exist
        with np.errstate(divide="ignore"):
            whole = max(vocabulary.total, 1)
            net.member_bias[:] = np.where(mass > 0, np.log(mass / whole), absent)
            net.class_bias[:] = np.concatenate([np.where(mass.sum(axis=1) > 0, np.log(mass.sum(axis=1) / whole), absent), np.log(vocabulary.ending_mass() / whole)])
        return net

    def like(self) -> Network:
        return Network(np.zeros_like(self.vector), self.hidden)

    def forward(self, symbols: np.ndarray, keep: np.ndarray, h: np.ndarray, memo: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each step of ``symbols`` (steps, lanes), and the last state; ``memo`` gets what backward needs. ``keep`` is 0 where a text starts."""
        size = self.hidden
        given = self.inputs[symbols]
        states = np.empty((*symbols.shape, size), np.float32)
        for t in range(len(symbols)):
            h = h * keep[t][:, None]
            x, u = given[t], h @ self.state
            gates = x[:, : 2 * size] + u[:, : 2 * size]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :size], gates[:, size:]
            inner = u[:, 2 * size :]
            inner += self.new_bias
            new = r * inner
            new += x[:, 2 * size :]
            np.tanh(new, out=new)
            before, h = h, h - new
            h *= z
            h += new
            states[t] = h
            if memo is not None:
                memo.append((before, z, r, inner, new))
        return states, h

    def backward(self, symbols: np.ndarray, keep: np.ndarray, memo: list, d_states: np.ndarray, grad: Network) -> None:
        size = self.hidden
        d_given = np.empty((*symbols.shape, 3 * size), np.float32)
        dh = np.zeros_like(d_states[0])
        for t in range(len(symbols) - 1, -1, -1):
            before, z, r, inner, new = memo[t]
            dh = dh + d_states[t]
            d_new = dh * (1 - z) * (1 - new * new)
            du = np.empty((len(dh), 3 * size), np.float32)
            du[:, :size] = dh * (before - new) * z * (1 - z)
            du[:, size : 2 * size] = d_new * inner * r * (1 - r)
            du[:, 2 * size :] = d_new * r
            d_given[t, :, : 2 * size], d_given[t, :, 2 * size :] = du[:, : 2 * size], d_new
            grad.state += before.T @ du
            grad.new_bias += du[:, 2 * size :].sum(axis=0)
            dh = (dh * z + du @ self.state.T) * keep[t][:, None]
        flat = symbols.ravel()
        order = np.argsort(flat, kind="stable")
        heads = np.flatnonzero(np.diff(flat[order], prepend=-1))
        grad.inputs[flat[order][heads]] += np.add.reduceat(d_given.reshape(-1, 3 * size)[order], heads)

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray, grad: Network | None = None, d_states: np.ndarray | None = None) -> np.ndarray:
        """Natural logarithm of each target's class, and of its share within it for neural tokens; with ``grad`` also the gradients of their negative sum."""
        groups = np.where(targets < NEURAL, targets // CLASS, targets - NEURAL + NEURAL // CLASS)
        out = _log_softmax(states, self.classes, self.class_bias, groups, *((grad.classes, grad.class_bias, d_states) if grad else ()))
        neural = np.flatnonzero(targets < NEURAL)
        neural = neural[np.argsort(groups[neural], kind="stable")]
        edges = np.flatnonzero(np.diff(groups[neural], prepend=-1, append=-1))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            rows = neural[low:high]
            k = groups[rows[0]]
            more = None if grad is None else np.zeros((len(rows), self.hidden), np.float32)
            out[rows] += _log_softmax(states[rows], self.members[k], self.member_bias[k], targets[rows] % CLASS, *((grad.members[k], grad.member_bias[k], more) if grad else ()))
            if grad:
                d_states[rows] += more
        return out


def _log_softmax(states, weights, bias, chosen, d_weights=None, d_bias=None, d_states=None) -> np.ndarray:
    logits = states @ weights
    logits += bias
    np.minimum(logits, 60.0, out=logits)  # so that no exponential overflows; what is normalised are these values
    rows = np.arange(len(chosen))
    picked = logits[rows, chosen]
    np.exp(logits, out=logits)
    sums = logits.sum(axis=1)
    if d_weights is not None:
        logits /= sums[:, None]
        logits[rows, chosen] -= 1
        d_weights += states.T @ logits
        d_bias += logits.sum(axis=0)
        d_states += logits @ weights.T
    return picked - np.log(sums)


def lanes(texts: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid one after another in lanes of about equal length: inputs, targets and text numbers (-1: none) by step and lane. A text's first input is the start."""
    sizes = [len(t) for t in texts]
    count = max(1, min(most, sum(sizes) // max(sizes)))
    heap = [(0, k) for k in range(count)]
    places = []
    for i in sorted(range(len(texts)), key=lambda i: -sizes[i]):
        at, k = heapq.heappop(heap)
        places.append((i, k, at))
        heapq.heappush(heap, (at + sizes[i], k))
    steps = -(-max(at for at, _ in heap) // WINDOW) * WINDOW
    given, wanted, owner = np.full((count, steps), _START, np.int32), np.zeros((count, steps), np.int32), np.full((count, steps), -1, np.int32)
    for i, k, at in places:
        given[k, at + 1 : at + sizes[i]] = texts[i][:-1]
        wanted[k, at : at + sizes[i]] = texts[i]
        owner[k, at : at + sizes[i]] = i
    return tuple(np.ascontiguousarray(x.T) for x in (given, wanted, owner))


def score_texts(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of the model's factors for each text of symbols."""
    given, wanted, owner = lanes(texts, SCORE_LANES)
    total = np.zeros(len(texts))
    h = np.zeros((given.shape[1], net.hidden), np.float32)
    for t in range(0, len(given), WINDOW):
        cut = slice(t, t + WINDOW)
        states, h = net.forward(given[cut], (given[cut] != _START).astype(np.float32), h)
        real = np.flatnonzero(owner[cut].ravel() >= 0)
        found = net.log_probabilities(states.reshape(-1, net.hidden)[real], wanted[cut].ravel()[real])
        total += np.bincount(owner[cut].ravel()[real], weights=found, minlength=len(texts))
    return total


class Trainer:
    """Truncated backpropagation with steps scaled by the root of each parameter's summed squared gradients."""

    def __init__(self, net: Network):
        self.net, self.squares, self.seen = net, np.full_like(net.vector, 1e-8), 0

    def learn(self, texts: list[np.ndarray]) -> None:
        given, wanted, owner = lanes([t[k : k + TRAIN_PIECE] for t in texts for k in range(0, len(t), TRAIN_PIECE)], TRAIN_LANES)
        net = self.net
        h = np.zeros((given.shape[1], net.hidden), np.float32)
        for t in range(0, len(given), WINDOW):
            cut = slice(t, t + WINDOW)
            keep = (given[cut] != _START).astype(np.float32)
            memo: list = []
            states, h = net.forward(given[cut], keep, h, memo)
            real = np.flatnonzero(owner[cut].ravel() >= 0)
            grad, d_states = net.like(), np.zeros((given[cut].size, net.hidden), np.float32)
            d_real = np.zeros((len(real), net.hidden), np.float32)
            net.log_probabilities(states.reshape(-1, net.hidden)[real], wanted[cut].ravel()[real], grad, d_real)
            d_states[real] = d_real
            net.backward(given[cut], keep, memo, d_states.reshape(states.shape), grad)
            grad.vector /= max(len(real), 1)
            self.squares += grad.vector * grad.vector
            net.vector -= RATE * grad.vector / np.sqrt(self.squares)
            self.seen += len(real)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes | None]:
    for batch in batches:
        column = batch.column("text")
        for i in range(batch.num_rows):
            yield column[i].as_py()


def token_counts(texts: DataFrame) -> DataFrame:
    """(word binary, c) over the tokens of ``texts`` (text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(counted.keys(), pa.binary()), "c": pa.array(counted.values(), pa.int64())})

        counted: Counter = Counter()
        for text in _texts(batches):
            counted.update(tokens(text))
            if len(counted) > MOST_COUNTED:
                yield out()
                counted = Counter()
        yield out()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network
    counts: DataFrame
    #: Tokens that the network was trained on.
    trained: int


def _vocabulary(counts: DataFrame) -> Vocabulary:
    # Sixteenths of octaves of counts: the known tokens are those of the lowest step from which on there are at most KNOWN of them.
    short, step = counts.where("octet_length(word) <= 64"), F.floor(F.log2("c") * 16)
    least, number = None, 0
    for r in sorted(short.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        number += r["count"]
        if number > KNOWN:
            break
        least = r["step"]
    top = sorted(((bytes(r["word"]), r["c"]) for r in short.where(step >= least).collect()), key=lambda r: (-r[1], r[0])) if least is not None else []
    words, known = [w for w, _ in top], np.array([c for _, c in top], np.int64)
    whole = counts.agg(F.sum("c"), F.count("*")).first()
    by_ending = counts.groupBy(F.expr(ENDING_SQL).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    total, distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in by_ending:
        total[r["k"]], distinct[r["k"]] = r["c"], r["n"]
    for w, c in zip(words[:NEURAL], known, strict=False):  # neural tokens are in no class of endings
        total[ending(w)] -= c
        distinct[ending(w)] -= 1
    return Vocabulary(words, known, int(whole[0] or 0), int(whole[1]), total, distinct)


def _averaged(parts: DataFrame, levels: tuple[list[str], ...]) -> DataFrame:
    """Rows (block, salt, seen, values) to their means weighted by ``seen``, by each of ``levels`` in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, total = None, 0, None

        def out() -> pa.RecordBatch:
            mean = (total / max(seen, 1)).astype(np.float32).tobytes()
            return pa.RecordBatch.from_pydict({"block": pa.array([key[0]], pa.int32()), "salt": pa.array([key[1]], pa.int32()), "seen": pa.array([seen], pa.int64()), "values": pa.array([mean], pa.binary())})

        for batch in batches:
            for block, salt, n, values in zip(*(batch.column(c) for c in ("block", "salt", "seen", "values")), strict=True):
                here = (block.as_py(), salt.as_py() if keep_salt else 0)
                if here != key:
                    if key is not None:
                        yield out()
                    key, seen, total = here, 0, 0.0
                seen += n.as_py()
                total = total + n.as_py() * np.frombuffer(values.as_py(), np.float32).astype(np.float64)
        if key is not None:
            yield out()

    for level in levels:
        keep_salt = "salt" in level
        parts = materialize(parts.repartition(*level).sortWithinPartitions(*level).mapInArrow(run, _PARTS), "gru-averages")
    return parts


_PARTS = "block int, salt int, seen long, values binary"


def fit(docs: DataFrame, training: Column, text: str = "text", ident: str = "doc_id") -> Model:
    """Counts over all rows of ``docs`` that ``training`` names, and the network trained on all of them, round by round."""
    spark = docs.sparkSession
    chosen = docs.where(training).select(F.col(text).cast("binary").alias("text"), F.expr(f"pmod(xxhash64(`{ident}`, `{text}`), 16)").alias("bucket"))
    counts = materialize(token_counts(chosen.select("text")), "token-counts")
    vocabulary = _vocabulary(counts)
    network, seen = Network.start(vocabulary), 0
    for buckets in ROUNDS if vocabulary.total else ():
        shared = spark.sparkContext.broadcast((vocabulary, network.vector))

        def train(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, vector = shared.value
            trainer, held, size = Trainer(Network(vector.copy())), [], 0
            for given in _texts(batches):
                held.append(known.encode(given)[1])
                size += len(held[-1])
                if size >= TRAIN_TOKENS:
                    trainer.learn(held)
                    held, size = [], 0
            if held:
                trainer.learn(held)
            if trainer.seen:
                blocks = np.array_split(trainer.net.vector, BLOCKS)
                salt = int(np.abs(trainer.net.vector[:64]).sum() * 1e6) % 64
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(range(BLOCKS), pa.int32()), "salt": pa.array([salt] * BLOCKS, pa.int32()), "seen": pa.array([trainer.seen] * BLOCKS, pa.int64()),
                    "values": pa.array([b.tobytes() for b in blocks], pa.binary()),
                })

        trained = chosen.where(F.col("bucket").isin(*buckets)).select("text").mapInArrow(train, _PARTS)
        rows = _averaged(trained, (["block", "salt"], ["block"])).select("block", "seen", "values").collect()
        if rows:
            seen += rows[0]["seen"]
            network = Network(np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(rows, key=lambda r: r["block"])]))
    return Model(vocabulary, network, counts, seen)


def score(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str, str, str, str]:
    """The columns of ``docs`` but the text, with four more, and their names: tokens, known tokens, base score and score (log10 probabilities of the whole text)."""
    spark, vocabulary = docs.sparkSession, model.vocabulary
    others = [c for c in docs.columns if c != text]
    names = fresh(docs, "n_tokens", "n_known", "base_score", "score")
    numbered = docs.select(*(F.col(f"`{c}`").alias(str(k)) for k, c in enumerate(others)), F.col(f"`{text}`").cast("binary").alias("text"))
    passing = T.StructType([f for f in numbered.schema.fields if f.name != "text"])
    more = T._parse_datatype_string("n_tokens long, n_known long, base_score double, score double, rare array<binary>, times array<int>")
    out = T.StructType(passing.fields + more.fields)
    shared = spark.sparkContext.broadcast((vocabulary, model.network.vector))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vector = shared.value
        net = Network(vector)
        for batch in batches:
            column, first = batch.column("text"), 0
            held, rows, size = [], [], 0
            for i in range(batch.num_rows):
                ranks, symbols, rare = known.encode(column[i].as_py())
                near = ranks[ranks >= 0]
                rows.append((len(ranks), len(near), float(known.base[near].sum()), float(known.within[near].sum()), list(rare), list(rare.values())))
                held.append(symbols)
                size += len(symbols)
                if size >= SCORE_TOKENS or i == batch.num_rows - 1:
                    n, near_n, base, within, rare_words, times = zip(*rows, strict=True)
                    scores = np.array(within) + score_texts(net, held) / _LN10
                    part = batch.slice(first, i + 1 - first)
                    made = [n, near_n, base, scores.tolist(), rare_words, times]
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(f.name) for f in passing), *(pa.array(m, t) for m, t in zip(made, types, strict=True))], names=[*(f.name for f in passing), *(f.name for f in more)]
                    )
                    held, rows, size, first = [], [], 0, i + 1

    table = materialize(numbered.mapInArrow(run, out).withColumn("row", F.monotonically_increasing_id()), "scored-texts")
    mass = vocabulary.ending_mass()
    masses = F.array(*(F.lit(float(m)) for m in mass))
    rare = table.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    joined = rare.join(model.counts, "word", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"), F.get(masses, F.expr(ENDING_SQL)).alias("mass"))
    whole = vocabulary.total + 0.5 * (vocabulary.distinct + 1)
    far = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / whole)).alias("base"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.col("mass"))).alias("within"),
    )
    full = table.join(far, "row", "left")
    zero = F.lit(0)
    made = [F.col("n_tokens"), F.col("n_known") + F.coalesce("known", zero), F.col("base_score") + F.coalesce("base", zero), F.col("score") + F.coalesce("within", zero)]
    return full.select(*(F.col(str(k)).alias(c) for k, c in enumerate(others)), *(m.alias(n) for m, n in zip(made, names, strict=True))), *names
