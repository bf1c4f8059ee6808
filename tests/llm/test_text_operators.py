"""Packing, audio, BPE and quality rules against plain versions."""

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from hyperloom.llm import audio, bpe, packing, quality_rules, queries

SF = "/root/testdata/sf0.01"
RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def duck(name, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(([r[k] for k in order] for r in cur.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    names, rows = duck(name)
    assert sorted(got.columns) == names
    assert sorted(([r[n] for n in names] for r in got.collect()), key=str) == rows


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    repeated = {p for v in at.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts_of_odd_rows(odd, none):
    for r in quality_rules.judge(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        n = brute_quality(r["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(odd).count() == 11
    assert quality_rules.judge(none).count() == 0


def check_packing(rows, texts, size=2048):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for ident, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[ident], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for k, r in enumerate(own):
            assert r["start"] == at and 0 < r["length"] <= size and (k == 0 or r["length"] == size)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
        assert len(own) == max(1, -(-len(ids) // size))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r["length"] for r in rows)
    return len(bins), -(-total // size)


def test_packing_whole_table(spark, texts):
    made, least = check_packing(queries.op3_best_fit_packing(spark, SF).collect(), texts)
    assert made <= least * 1.01 + 1


def test_packing_odd_rows(spark, odd, none):
    cut = packing.pieces(odd, P.path("byte_bpe_50k.json"), P.PATTERN)
    rows = packing.pack(cut).collect()
    assert Counter(r["doc_id"] for r in rows)[7] == 2
    assert [r["length"] for r in rows if r["doc_id"] in (3, 4)] == [1, 1]
    assert packing.pack(packing.pieces(none, P.path("byte_bpe_50k.json"), P.PATTERN)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_respects_every_capacity(rule):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 90, 400)
    capacity = packing.Capacity(tokens=100, documents=4, attention=6000, weights=(1.0, 0.3, 0.2), rule=rule)
    bins, offsets = packing.best_fit(lengths, capacity)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (len(own) == 1 or (own**2).sum() <= 6000)
        assert sorted(offsets[bins == b].tolist()) == (np.cumsum(own[np.argsort(offsets[bins == b])]) - own[np.argsort(offsets[bins == b])]).tolist()


@pytest.mark.parametrize("ordinary", [False, True])
def test_special_strings_as_in_the_library(ordinary):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = ordinary
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "a  <|endoftext|>\n\n b <|endoftext|", "naïve 漢字 😀\n\n  x", "don't  stop"):
        assert packing.token_ids(text, P.path("byte_bpe_50k.json"), P.PATTERN, not ordinary).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    blank = "a" + " " * 1_200_000 + "b<|endoftext|>" + " " * 1_200_000 + "c"
    assert packing.token_ids(blank, P.path("byte_bpe_50k.json"), P.PATTERN, not ordinary).tolist() == tokenizer.encode(blank, add_special_tokens=False).ids


def plain_pcm(codec, payload):
    """Decoded and resampled sample by sample."""
    if codec == "ima_adpcm":
        samples = [x for i in range(0, len(payload), 192) for x in plain_adpcm(payload[i : i + 192])]
    else:
        samples = [plain_g711(codec, code) for code in payload]
    wide = []
    for k, x in enumerate(samples):
        after = samples[k + 1] if k + 1 < len(samples) else x
        wide += [x, (x + after) // 2]
    return wide


def plain_g711(codec, code):
    """One code by the segments of the standard."""
    if codec == "mulaw":
        code ^= 0xFF
        size = (((code & 15) * 2 + 33) << ((code >> 4) & 7)) - 33
        return (-1 if code & 0x80 else 1) * size * 4
    code ^= 0x55
    segment, step = (code >> 4) & 7, code & 15
    size = step * 2 + 1 if segment == 0 else (step * 2 + 33) << (segment - 1)
    return (1 if code & 0x80 else -1) * size * 8


def test_audio_query(spark, texts):
    seen = Counter()
    for r in queries.op4_telephony_audio(spark, SF).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        codec, rate, *_ = r["feature"].split("|")
        assert codec == ("mulaw", "alaw", "ima_adpcm")[zlib.crc32(payload) % 3] and rate == "rate=16000"
        body = payload
        head = {"mulaw": struct.pack("<HHIIHHH", 7, 1, 8000, 8000, 1, 8, 0), "alaw": struct.pack("<HHIIHHH", 6, 1, 8000, 8000, 1, 8, 0), "ima_adpcm": struct.pack("<HHIIHHHH", 17, 1, 8000, 8000 * 192 // 377, 192, 4, 2, 377)}[codec]
        frames = len(body) // 192 * 377 if codec == "ima_adpcm" else len(body)
        chunks = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, frames) + b"data" + struct.pack("<I", len(body)) + body
        media = b"RIFF" + struct.pack("<I", len(chunks)) + chunks
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        seen[codec] += 1
        if seen[codec] <= 25:
            pcm = plain_pcm(codec, payload)
            square, cross = sum(x * x for x in pcm) // len(pcm), sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))
            crc = zlib.crc32(struct.pack(f"<{len(pcm)}h", *pcm))
            assert r["feature"] == f"{codec}|rate=16000|n={len(pcm)}|peak={max(map(abs, pcm))}|ms={square}|zc={cross}|pcm={crc:08x}"
    assert min(seen.values()) > 100


def test_audio_odd_rows(odd, none):
    rows = audio.media_digests(audio.store_pcm(audio.store_text_media(odd))).collect()
    assert len(rows) == 11 and {r["payload_bytes"] for r in rows if r["doc_id"] in (3, 4)} == {192}
    assert len({tuple(r) for r in rows if r["doc_id"] == 7}) == 1
    assert audio.media_digests(audio.store_pcm(audio.store_text_media(none))).count() == 0
    decoded = audio.decode_media(audio.store_text_media(odd)).collect()
    assert all(len(r["pcm"]) > 0 and len(r["payload"]) % 192 == 0 for r in decoded)


def test_pcm_is_stored_losslessly():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 3, 4, 1001):
        samples = rng.integers(-32768, 32768, size).astype(np.int16)
        assert np.array_equal(audio.unpack_pcm(audio.pack_pcm(samples)), samples)
        wide = audio.resample(samples)
        stored = audio.pack_pcm(wide)
        assert np.array_equal(audio.unpack_pcm(stored), wide) and not any(stored[2 * size :])


def test_g711_tables_at_known_points():
    mu, a = audio.TABLES["mulaw"], audio.TABLES["alaw"]
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def plain_adpcm(unit):
    value, index = struct.unpack_from("<hB", unit)
    index = min(index, 88)
    out = [value]
    for byte in unit[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(audio.STEP_SIZE[index])
            diff = step >> 3
            if nibble & 4:
                diff += step
            if nibble & 2:
                diff += step >> 1
            if nibble & 1:
                diff += step >> 2
            value = max(-32768, min(32767, value - diff if nibble & 8 else value + diff))
            index = max(0, min(88, index + int(audio.INDEX_STEP[nibble])))
            out.append(value)
    return out


def test_adpcm_equals_sample_by_sample():
    units = np.random.default_rng(2).integers(0, 256, (7, 64)).astype(np.uint8)
    assert audio.decode_adpcm(units).tolist() == [plain_adpcm(u.tobytes()) for u in units]


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_bpe(rows, texts):
    enc = tik()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_query(spark, texts):
    rows = queries.op5_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    check_bpe(rows, texts)


def test_bpe_odd_rows_and_small_blocks(odd, none):
    encoded = bpe.encode(odd, RANKS, P.PATTERN, block_bytes=50)
    rows = bpe.digests(bpe.decode(encoded, RANKS)).collect()
    assert len(rows) == 11
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    check_bpe(rows, texts)
    assert bpe.encode(none, RANKS, P.PATTERN).count() == 0


def test_bpe_repeated_and_null_ids(spark):
    """Rows that share an id, or have none, in several partitions, with equal words in the same first order but different texts."""
    texts = ["alpha beta", "alpha beta beta", "alpha beta", "alpha", "alpha beta beta alpha"]
    rows = [(i, t) for i in (1, 2, None) for t in texts]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    coder = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    wanted = sorted((str(i), coder.encode_ordinary(t)) for i, t in rows)
    for size in (1, 12, 1 << 20):
        got = bpe.encode(frame, RANKS, P.PATTERN, block_bytes=size).collect()
        assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == wanted


def test_bpe_long_text_is_cut_like_a_short_one(spark, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 20)
    frame = spark.createDataFrame([(1, "one two  three \n four " * 40)], "doc_id long, text string")
    coder = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    batch = next(iter(frame.toArrow().to_batches()))
    assert [b[1] for b in bpe._text_blocks([batch], 10)] == [["one two  three \n four " * 40]]
    assert np.frombuffer(bpe.encode(frame, RANKS, P.PATTERN).first()["ids"], "<u4").tolist() == coder.encode_ordinary("one two  three \n four " * 40)


def test_bpe_endless_white_space(spark):
    text = "a" + " " * 1_200_000 + "b"
    row = bpe.decode(bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, P.PATTERN), RANKS).first()
    assert bytes(row["decoded"]).decode() == text


def test_vote_estimates_recover_planted_accuracies(spark):
    """Votes drawn with known rates from two classes: the estimates come near them, although they start elsewhere."""
    rng = np.random.default_rng(11)
    rules = list(quality_rules.RULES)
    rates = {r: ((0.6 + 0.03 * k, 0.02 + 0.005 * k), (0.2 + 0.02 * k, 0.3 + 0.03 * k)) for k, r in enumerate(rules)}
    good = rng.random(40_000) < 0.7
    votes = []
    for r in rules:
        up, down = (np.where(good, rates[r][0][v], rates[r][1][v]) for v in (0, 1))
        u = rng.random(len(good))
        votes.append(np.where(u < up, 1, np.where(u < up + down, -1, 0)))
    seen = Counter(zip(*(v.tolist() for v in votes), strict=True))
    patterns = spark.createDataFrame([(*p, n) for p, n in seen.items()], [*rules, "n"])
    model = quality_rules.fit(patterns, rules, rounds=25)
    assert abs(model.prior - 0.7) < 0.02
    for r in rules:
        assert np.abs(np.array(model.rates[r]) - np.array(rates[r])).max() < 0.03


def test_repeated_words_of_a_very_long_text(spark):
    text = " ".join(f"w{k}" for k in range(1_000_000))
    twice = " ".join(f"w{k % 600_000}" for k in range(1_000_000))
    rows = quality_rules.metrics(spark.createDataFrame([(1, text), (2, twice)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_repeat_words"] for r in rows] == [0, 800_000]
