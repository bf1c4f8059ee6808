"""Best-fit packing of documents into sequences, with several capacities.

A document is its ids and an end id. Only documents longer than a sequence are cut, into full sequences; the
remainder, if any, is their first piece. Pieces then go, longest first, to the open sequence with the best score among those with room in every
dimension: tokens, documents, and attention cost (the sum of squared piece lengths). The score is the weighted squared norm
of what would stay free, or the weighted dot product of demand and free room.

Full pieces need no search. The others are dealt by a hash into groups of bounded size, so each task packs a bounded number of pieces and a group
wastes at most about one sequence.

Null texts count as empty and give one piece, the end id. Repeated rows are packed as often as they occur. An empty table gives
no pieces. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.bpe import splitter
from hyperloom.llm.storage import materialize

PIECES_PER_GROUP = 16_000
_loaded: dict[str, object] = {}


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"  # or "dot"


def _vocabulary(path: str, pattern: str):
    """Encoder for a byte-level BPE vocabulary in the tokenizers format: ids are ranks, merges follow their order; its added tokens are whole."""
    if path not in _loaded:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        # The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow from 256.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in added}
        _loaded[path] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return _loaded[path]


def token_ids(text: str, path: str, pattern: str, specials: bool = True) -> np.ndarray:
    """Ids as the tokenizers library gives them with add_special_tokens=False: none are added, but the string of an added token in a text is that token
    (ordinary text if not ``specials``, as with the library's encode_special_tokens)."""
    coder = _vocabulary(path, pattern)
    allowed = coder.special_tokens_set if specials else set()
    try:
        return coder.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
    except BaseException as error:
        if type(error).__name__ != "PanicException" and "stack size" not in str(error):
            raise
    # White space too long for the encoder's own matching: match by match, between the added tokens.
    names = "|".join(re.escape(t) for t in sorted(allowed, key=len, reverse=True))
    ids = []
    for part in re.split(f"({names})", text) if names else [text]:
        if part in allowed:
            ids.append(coder.encode_single_token(part))
        else:
            ids += [i for piece in splitter(pattern).findall(part) for i in coder._encode_single_piece(piece.encode())]
    return np.array(ids, np.uint32)


def pieces(docs: DataFrame, vocabulary: str, pattern: str, size: int = 2048, end_id: int = 0, ident: str = "doc_id", text: str = "text", specials: bool = True) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): ``row`` tells repeated rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        for batch in batches:
            take, piece, start, length, crc = [], [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([token_ids(t, vocabulary, pattern, specials), end]) if t else end
                raw = memoryview(ids.astype("<u4").tobytes())
                cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                for n, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    take.append(k)
                    piece.append(n)
                    start.append(i)
                    length.append(j - i)
                    crc.append(zlib.crc32(raw[4 * i : 4 * j]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[ident].dataType.simpleString()
    cut = docs.select(ident, text).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    return materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; pieces are taken longest first, ties in their order."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    weight = np.array(capacity.weights)
    demand = np.stack([lengths, np.ones(len(lengths)), np.minimum(lengths.astype(np.float64) ** 2, full[2])], axis=1)
    free = np.empty((len(lengths), 3))
    names = np.empty(len(lengths), np.int64)
    used = np.zeros(len(lengths), np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    live = made = 0
    smallest = demand[:, 0].min(initial=0)
    scale = weight / full**2
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = demand[k]
        room = free[:live]
        ok = np.flatnonzero((room[:, 0] >= need[0]) & (room[:, 1] >= 1) & (room[:, 2] >= need[2]))
        if len(ok):
            if capacity.rule == "dot":
                at = ok[np.argmax(room[ok] @ (need * scale))]
            else:
                at = ok[np.argmin(((room[ok] - need) ** 2) @ scale)]
        else:
            at = live
            free[at], names[at], used[made] = full, made, 0
            live, made = live + 1, made + 1
        name = names[at]
        bins[k], offsets[k] = name, used[name]
        used[name] += lengths[k]
        free[at] -= need
        if free[at, 0] < smallest or free[at, 1] < 1 or free[at, 2] <= 0:  # closed: the last open one takes its place
            live -= 1
            free[at], names[at] = free[live], names[live]
    return bins, offsets


def pack(cut: DataFrame, capacity: Capacity = Capacity(), per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (row, doc_id, piece, start, length, ids_crc32)."""
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    alone = F.col("length") >= capacity.tokens
    count = cut.where(~alone).count()
    groups = max(1, -(-count // per_group))
    rest = cut.where(~alone).withColumn("grp", F.pmod(F.xxhash64("row", "piece", "length"), F.lit(groups)))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, offsets = best_fit(frame["length"].to_numpy(), capacity)
        return frame[keep].assign(sequence_id=(frame["grp"].to_numpy() << 32) + bins, offset=offsets)

    kinds = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in keep)
    packed = rest.groupBy("grp").applyInPandas(one, f"{kinds}, sequence_id long, offset long")
    # Full pieces are sequences of their own, numbered below zero.
    own = cut.where(alone).select(*keep, (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.union(own)
