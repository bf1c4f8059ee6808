"""Byte-level BPE over a global table of distinct words.

1. One pass over the texts cuts them into pre-tokens, block by block (a block is bounded in bytes, a longer text is a block of its own). A block sends out
   its pre-tokens in packed form: each document's as positions in the block's list of distinct words, and this list, split by a hash of the word. Both go
   through one exchange, the positions by block, the words by hash, so that a word meets itself from all blocks in one task.
2. Each distinct word is encoded once there, and its ids go back to the blocks that have it.
3. Positions and ids of a block meet by its name, and the ids are put in place by position.

A block is named by a digest of its ids and whole texts, so equal names only occur for equal blocks, and a task that is run again gives the same names. As with
any plan, the rows of ``docs`` have to come back in the same order when a task is run again, as they do from files.

Decoding joins the ids with the table of token bytes. That table is as large as the vocabulary file, whatever the input, so it is
held by each task.

Null texts count as empty and give no tokens. Repeated rows and ids, also null ones with different texts, are kept as they are; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.storage import partitions_for

BLOCK_BYTES, SLICE_ROWS, LONG_TEXT = 8 << 20, 64, 1 << 20
#: Input bytes for each partition of the exchanges, and the most parts of a block's word list: beyond it a part holds too few words to pay for a row.
PARTITION_BYTES, MOST_BUCKETS = 32 << 20, 8192
_loaded: dict[str, object] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoder(path: str, pattern: str):
    """The encoder for a rank file, loaded once in each Python worker."""
    import tiktoken

    key = f"encoder:{path}"
    if key not in _loaded:
        _loaded[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _loaded[key]


def splitter(pattern: str):
    import regex

    key = f"pattern:{pattern}"
    if key not in _loaded:
        _loaded[key] = regex.compile(pattern)
    return _loaded[key]


def pack(*arrays: np.ndarray) -> bytes:
    """uint32 arrays as compressed byte planes."""
    head = np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()
    planes = b"".join(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    return head + zstandard.ZstdCompressor(level=3).compress(planes)


def unpack(blob: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(blob, "<u4", 1)[0])
    sizes = np.frombuffer(blob, "<u4", count, 4).tolist()
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4 * (count + 1) :], max_output_size=4 * sum(sizes) + 1), np.uint8)
    out, at = [], 0
    for n in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 4 * n].reshape(4, n).T).view("<u4").ravel())
        at += 4 * n
    return out


def encode_pieces(text: str, ranks_path: str, pattern: str) -> list[int]:
    """Match by match; for texts with white space too long for the encoder's own matching (it panics there)."""
    single = encoder(ranks_path, pattern)._encode_single_piece
    return [i for piece in splitter(pattern).findall(text) for i in single(piece.encode("utf-8"))]


class _Numbered(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _text_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of consecutive rows, in blocks of about ``block_bytes`` characters."""
    ids, texts, size = [], [], 0
    # A batch may hold many times the texts of a block: only some rows at a time become Python strings.
    for rows in (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS)):
        for ident, text in zip(rows.column(0).cast(pa.string()).to_pylist(), rows.column(1).to_pylist(), strict=True):
            ids.append(ident)
            texts.append(text or "")
            size += len(text or "")
            if size >= block_bytes:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _block_name(ids: list, texts: list[str]) -> int:
    digest = hashlib.blake2b(repr(ids).encode(), digest_size=8)
    for text in texts:
        digest.update(b"%d:" % len(text))
        digest.update(text.encode())
    return int.from_bytes(digest.digest(), "little") >> 1


def _pretokens(docs: DataFrame, pattern: str, buckets: int, block_bytes: int) -> DataFrame:
    """(dest, block, ids, x, y), two kinds of rows. ``dest`` = block: the ids of the block's documents, and in ``x`` how many pre-tokens each has and every pre-token's
    place in the block's words. ``dest`` < 0, one for each hash bucket: places (``x``) and bytes (``y``) of the words in it, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = splitter(pattern)
        for ids, texts in _text_blocks(batches, block_bytes):
            number, counts, codes = _Numbered(), [], [np.zeros(0, np.uint32)]
            for text in texts:
                # The matches of a long text are never held as strings all at once.
                found = cut.findall(text) if len(text) < LONG_TEXT else (m.group() for m in cut.finditer(text))
                codes.append(np.fromiter(map(number.__getitem__, found), np.uint32))
                counts.append(len(codes[-1]))
            flat = np.concatenate(codes)
            order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
            place = np.empty(len(number), np.uint32)
            place[order] = np.arange(len(number), dtype=np.uint32)
            name = _block_name(ids, texts)
            yield _exchange_row([name], [name], [ids], [pack(np.array(counts, np.uint32), place[flat])], [None])
            words = [w.encode() for w in number]
            by_bucket: dict[int, list[int]] = {}
            for k in order.tolist():
                by_bucket.setdefault(zlib.crc32(words[k]) % buckets, []).append(k)
            places = [pack(place[w], np.fromiter((len(words[k]) for k in w), np.uint32, len(w))) for w in by_bucket.values()]
            held = [zstandard.compress(b"".join(words[k] for k in w), 3) for w in by_bucket.values()]
            yield _exchange_row([-1 - b for b in by_bucket], [name] * len(held), [None] * len(held), places, held)

    return docs.mapInArrow(run, "dest long, block long, ids array<string>, x binary, y binary")


def _exchange_row(dest: list, block: list, ids: list, x: list, y: list) -> pa.RecordBatch:
    columns = [pa.array(dest, pa.int64()), pa.array(block, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(x, pa.binary()), pa.array(y, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["dest", "block", "ids", "x", "y"])


def _encode_words(exchanged: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(dest, tokens) from the word rows: each distinct word is encoded once, and the ids go to the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern).encode_ordinary
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            batch = batch.filter(pa.array(batch.column(0).to_numpy() < 0))
            out = []
            for places, words in zip(batch.column(3), batch.column(4), strict=True):
                at, lengths = unpack(places.as_py())
                raw = zstandard.decompress(words.as_py())
                got, start = [], 0
                for n in lengths.tolist():
                    word = raw[start : start + n]
                    start += n
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encode(word.decode()) if n < 10_000 else encode_pieces(word.decode(), ranks_path, pattern)
                    got.append(ids)
                sizes = np.fromiter(map(len, got), np.uint32, len(got))
                out.append(pack(at, sizes, np.fromiter((t for ids in got for t in ids), np.uint32, int(sizes.sum()))))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], names=["dest", "tokens"])

    return exchanged.mapInArrow(run, "dest long, tokens binary")


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + size[i]] one after the other."""
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    return flat[at + np.repeat(start - (ends - size), size)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, ident: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids): token ids of each whole text as little-endian unsigned 32-bit integers in a binary column."""
    count = partitions_for(docs, PARTITION_BYTES)
    # Both uses below are one exchange, which Spark runs once and reads twice; a filter between them would make two of it.
    exchanged = _pretokens(docs.select(ident, text), pattern, min(count, MOST_BUCKETS), block_bytes).repartition(count, "dest")
    tokens = _encode_words(exchanged, ranks_path, pattern).repartition(count, "dest")

    def reassemble(own: pa.Table, words: pa.Table) -> pa.Table:
        ids, out = [], []
        if own.num_rows and own["dest"][0].as_py() >= 0:
            parts = [unpack(x.as_py()) for x in words["tokens"]]
            total = max((int(p[0].max(initial=0)) + 1 for p in parts), default=0)
            start, size = np.full(total, -1, np.int64), np.zeros(total, np.int64)
            at = 0
            for place, sizes, _ in parts:
                size[place] = sizes
                start[place] = at + np.cumsum(sizes, dtype=np.int64) - sizes
                at += int(sizes.sum())
            flat = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint32)
            for names, blob in zip(own["ids"].to_pylist(), own["x"], strict=True):
                counts, codes = unpack(blob.as_py())
                if len(codes) and (int(codes.max()) >= total or (start[codes] < 0).any()):
                    raise RuntimeError("a word of a block came back without ids")
                done = 0
                for name, n in zip(names, counts.tolist(), strict=True):
                    code = codes[done : done + n]
                    done += n
                    ids.append(name)
                    out.append(gather(flat, start[code], size[code]).astype("<u4").tobytes())
        return pa.table({"doc_id": pa.array(ids, pa.string()), "ids": pa.array(out, pa.binary())})

    placed = exchanged.groupBy("dest").cogroup(tokens.groupBy("dest")).applyInArrow(reassemble, "doc_id string, ids binary")
    return placed.select(F.col("doc_id").cast(docs.schema[ident].dataType).alias("doc_id"), "ids")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded``, the bytes of the ids, by position in the token-byte table."""

    def table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = f"bytes:{ranks_path}"
        if key not in _loaded:
            by_id = {i: raw for raw, i in read_ranks(ranks_path).items()}
            size = np.array([len(by_id.get(i, b"")) for i in range(max(by_id) + 1)], np.int64)
            _loaded[key] = (np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(size))), np.uint8), np.cumsum(size) - size, size)
        return _loaded[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, start, size = table()
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                ids = np.frombuffer(raw or b"", "<u4")
                out.append(gather(flat, start[ids], size[ids]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """The digest columns of op5."""
    return decoded.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
