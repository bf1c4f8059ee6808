"""Telephony audio columns: G.711 mu-law and A-law by lookup table, IMA ADPCM by numpy across blocks.

Media are RIFF/WAVE files in a binary column. Expansion tables hold one 16-bit value for each of the 256 codes. ADPCM blocks all start
with their own state, so one step decodes the next nibble of every block of a batch at once. Decoded samples are 16-bit PCM, resampled
linearly to the target rate and stored, losslessly, as the even samples (as positions where all are on a G.711 grid, else as differences) and what the odd ones differ from the mean of their neighbours. Features are computed from
the stored PCM as it is read back.

A row holds a whole file, 8 bytes of PCM for a byte of ADPCM. Null texts or media count as empty; an empty payload is padded to one unit; equal payloads give equal files and features. An
empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from hyperloom.llm.storage import materialize
from hyperloom.llm.textvec import blocks

RATE, TARGET_RATE, UNIT = 8000, 16000, 192
#: Level and page size of compression of stored media and PCM, the bulk of what this operator writes.
LEVEL, PAGE_BYTES = 9, 8 << 20
#: WAVE format tags (fixed values of the RIFF registry).
TAGS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}
NAMES = {tag: name for name, tag in TAGS.items()}
#: IMA ADPCM index steps (fixed values of the standard).
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: IMA ADPCM step sizes (fixed values of the standard).
STEP_SIZE = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
     209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272,
     2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500,
     20350, 22385, 24623, 27086, 29794, 32767], np.int32)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted code = sign, exponent, mantissa with a bias of 132."""
    code = ~np.arange(256) & 0xFF
    exponent, mantissa = (code >> 4) & 7, code & 15
    magnitude = (((mantissa << 3) + 132) << exponent) - 132
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted, positive with the sign bit set."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    magnitude = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_adpcm(units: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks (one row each): the header's sample, then two for each further byte."""
    count, width = units.shape
    value = units[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(units[:, 2].astype(np.int32), 0, 88)
    out = np.empty((width * 2 - 7, count), np.int16)
    out[0] = value
    body = np.ascontiguousarray(units[:, 4:].T)
    row = 1
    for byte in body:
        for nibble in (byte & 15, byte >> 4):
            step = STEP_SIZE[index]
            delta = step >> 3
            delta += (step >> 2) * (nibble & 1)
            delta += (step >> 1) * ((nibble >> 1) & 1)
            delta += step * ((nibble >> 2) & 1)
            value = np.clip(np.where(nibble & 8, value - delta, value + delta), -32768, 32767)
            index = np.clip(index + INDEX_STEP[nibble], 0, 88)
            out[row] = value
            row += 1
    return np.ascontiguousarray(out.T)


def resample(samples: np.ndarray, rate: int = RATE, target: int = TARGET_RATE) -> np.ndarray:
    """Linear interpolation; integer arithmetic where the rate doubles."""
    if rate == target or len(samples) == 0:
        return samples
    if target == 2 * rate:
        wide = samples.astype(np.int32)
        out = np.empty(2 * len(samples), np.int16)
        out[0::2] = samples
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = samples[-1]
        return out
    at = np.arange(len(samples) * target // rate) * (rate / target)
    return np.round(np.interp(at, np.arange(len(samples)), samples)).astype(np.int16)


def wave(codec: str, payload: bytes, unit: int = UNIT, rate: int = RATE) -> bytes:
    """A WAVE file around codec bytes, mono."""
    if codec == "ima_adpcm":
        per = unit * 2 - 7
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * unit // per, unit, 4, 2, per)
        frames = len(payload) // unit * per
    else:
        fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0)
        frames = len(payload)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, frames) + b"data" + struct.pack("<I", len(payload)) + payload
    body += b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwave(media: bytes) -> tuple[str, bytes, int]:
    """(codec, codec bytes, block size) of a WAVE file of one of our codecs."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, codec, unit = 12, None, 1
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, _, _, _, unit = struct.unpack_from("<HHIIH", media, at + 8)
            if tag not in NAMES:
                raise ValueError(f"unknown WAVE format tag {tag}")
            codec = NAMES[tag]
        elif kind == b"data":
            return codec, media[at + 8 : at + 8 + size], unit
        at += 8 + size + (size & 1)
    raise ValueError("WAVE file without data")


def choose_codec(payload: bytes) -> str:
    """One of the three codecs, by the payload alone."""
    return ("mulaw", "alaw", "ima_adpcm")[zlib.crc32(payload) % 3]


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + b" " * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def store_text_media(docs: DataFrame, ident: str = "doc_id", text: str = "text", unit: int = UNIT) -> DataFrame:
    """(id, n_bytes, media): each text's padded UTF-8 bytes as codec bytes of a WAVE file, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
            media = [wave(choose_codec(p), p, unit) for p in (padded(x, unit) for x in raws)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raws], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema[ident].dataType.simpleString()
    return materialize(docs.select(ident, text).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary"), "media", LEVEL, PAGE_BYTES)


def decode_batch(media: list[bytes]) -> tuple[list[str], list[bytes], list[np.ndarray]]:
    """Codec, codec bytes and PCM of each file; the ADPCM blocks of all files are decoded together."""
    parsed = [unwave(x) for x in media]
    pcm: list = [None] * len(media)
    by_unit: dict[int, list[int]] = {}
    for k, (codec, payload, unit) in enumerate(parsed):
        if codec == "ima_adpcm":
            by_unit.setdefault(unit, []).append(k)
        else:
            pcm[k] = TABLES[codec][np.frombuffer(payload, np.uint8)]
    for unit, rows in by_unit.items():
        whole = [np.frombuffer(parsed[k][1], np.uint8)[: len(parsed[k][1]) // unit * unit].reshape(-1, unit) for k in rows]
        samples, at = decode_adpcm(np.concatenate(whole)), 0
        for k, part in zip(rows, whole, strict=True):
            pcm[k] = samples[at : at + len(part)].ravel()
            at += len(part)
    return [x[0] for x in parsed], [x[1] for x in parsed], pcm


def predicted(even: np.ndarray, count: int) -> np.ndarray:
    """What linear interpolation between the even samples gives for ``count`` odd ones."""
    wide = even.astype(np.int32)
    return ((wide + np.append(wide[1:], wide[-1:])) >> 1)[:count].astype(np.int16)


def pack_pcm(samples: np.ndarray) -> bytes:
    """The even samples, then the odd ones less their prediction (modulo 2^16), as little-endian 16-bit integers."""
    even, odd = samples[0::2], samples[1::2]
    return np.concatenate([even, odd - predicted(even, len(odd))]).astype("<i2").tobytes()


def unpack_pcm(raw: bytes) -> np.ndarray:
    stored = np.frombuffer(raw, "<i2")
    out = np.empty(len(stored), np.int16)
    even = stored[: -(-len(stored) // 2)]
    out[0::2], out[1::2] = even, stored[len(even) :] + predicted(even, len(stored) // 2)
    return out


#: Position on each G.711 grid of every 16-bit sample, and which samples are on it.
GRIDS = [(np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, bool)) for _ in ("mulaw", "alaw")]
for (_places, _on), _table in zip(GRIDS, (TABLES["mulaw"], TABLES["alaw"]), strict=True):
    _places[_table.view(np.uint16)] = np.arange(256)
    _on[_table.view(np.uint16)] = True


def shrink_pcm(samples: np.ndarray) -> bytes:
    """``pack_pcm`` behind a byte for the form of the even samples: 0 or 1 as one-byte positions where all are on the mu-law or A-law grid, else 2, each less the one before (modulo 2^16)."""
    raw = np.frombuffer(pack_pcm(samples), "<i2")
    even, odd = np.split(raw, [-(-len(raw) // 2)])
    for form, (places, on) in enumerate(GRIDS):
        if on[even.view(np.uint16)].all():
            return bytes([form]) + places[even.view(np.uint16)].tobytes() + odd.tobytes()
    return b"\x02" + np.diff(even, prepend=np.int16(0)).tobytes() + odd.tobytes()


def grow_pcm(stored: bytes) -> np.ndarray:
    form, body = stored[0], np.frombuffer(stored, np.uint8)[1:]
    if form == 2:
        raw = body.copy().view("<i2")
        half = -(-len(raw) // 2)
        raw[:half] = np.cumsum(raw[:half], dtype=np.int16)
        return unpack_pcm(raw.tobytes())
    # A byte for an even sample and two for an odd one, of which there are as many or one less.
    half = -(-len(body) // 3)
    even = TABLES[("mulaw", "alaw")[form]][body[:half]]
    return unpack_pcm(even.astype("<i2").tobytes() + body[half:].tobytes())


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about a megabyte in a binary column."""
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    for i, j in blocks(sizes):
        yield batch.slice(i, j - i)


def decode_media(media: DataFrame, ident: str = "doc_id", column: str = "media") -> DataFrame:
    """(id, codec, payload, pcm): codec bytes and resampled 16-bit PCM of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                codecs, payloads, pcm = decode_batch([x if x else wave("mulaw", b"") for x in part.column(1).to_pylist()])
                wide = [resample(x).astype("<i2").tobytes() for x in pcm]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codecs), pa.array(payloads, pa.binary()), pa.array(wide, pa.binary())], names=["doc_id", "codec", "payload", "pcm"])

    kind = media.schema[ident].dataType.simpleString()
    return media.select(ident, column).mapInArrow(run, f"doc_id {kind}, codec string, payload binary, pcm binary")


def store_pcm(media: DataFrame) -> DataFrame:
    """Stored media (doc_id, n_bytes, media) read back, decoded, resampled, and the PCM (``shrink_pcm``) written to the shared folder beside digests of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                files = part.column(2).to_pylist()
                codecs, payloads, pcm = decode_batch(files)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(x) for x in payloads], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in payloads]),
                     pa.array([zlib.crc32(x[-16:]) for x in payloads], pa.int64()), pa.array([len(x) for x in files], pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in files]), pa.array(codecs), pa.array([shrink_pcm(resample(x)) for x in pcm], pa.binary())],
                    names=[*DIGESTS, "codec", "pcm"],
                )

    kind = media.schema["doc_id"].dataType.simpleString()
    return materialize(media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, {DIGEST_TYPES}, codec string, pcm binary"), "pcm", LEVEL, PAGE_BYTES)


def summary(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, peak, mean square, zero crossings and CRC of resampled PCM; integers only."""
    x = pcm.astype(np.int32)
    # Squares of 16-bit samples, summed in 64 bits.
    square = int(np.einsum("i,i->", x, x, dtype=np.int64)) // max(1, len(x))
    peak = int(np.abs(x).max(initial=0))
    cross = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{codec}|rate={TARGET_RATE}|n={len(x)}|peak={peak}|ms={square}|zc={cross}|pcm={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


DIGESTS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
DIGEST_TYPES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def media_digests(stored: DataFrame) -> DataFrame:
    """The columns of op4 from stored PCM (``store_pcm``), whose samples are read back for the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 8):
                features = [summary(c, grow_pcm(x.as_py())) for c, x in zip(part.column(7).to_pylist(), part.column(8), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:7], pa.array(features, pa.string())], names=[*DIGESTS, "feature"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select(*DIGESTS, "codec", "pcm").mapInArrow(run, f"doc_id {kind}, {DIGEST_TYPES}, feature string")
