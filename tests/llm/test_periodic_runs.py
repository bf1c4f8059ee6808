import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from hyperloom.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def altered(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def plain_runs(words):
    """Every (start, length, smallest period), by growing each stretch word by word and testing smaller periods one by one."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            size = end + q - i
            if size >= max(24, 3 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                found.append((i, size, q))
            i = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = altered(doc_id, text)
    runs = plain_runs(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def run(docs, work=periodic_runs.WORK):
    found, _, runs, collapsed = periodic_runs.find_runs(periodic_runs.with_tails(docs), work=work)
    return sorted((tuple(r[c] for c in COLUMNS) for r in periodic_runs.digests(found, runs, collapsed).collect()), key=str)


@pytest.fixture(scope="module")
def repetitive(spark):
    """Texts of few different words, with repeats of units, repeats of repeats, ties, and touching runs."""
    rng, rows = random.Random(5), []
    for k in range(160):
        words = []
        while len(words) < rng.choice((0, 20, 90, 250)):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            words += unit * rng.choice((1, 1, 2, 3, 4, 9, 30)) + unit[: rng.randint(0, len(unit))]
            words += [rng.choice("abcdefgh") for _ in range(rng.choice((0, 0, 3, 11)))]
        rows.append((k // 2 if k % 9 == 0 else k, rng.choice((" ", "\n", "\t ")).join(words)))
    rows += [(500, "x " * 24), (501, "x " * 23), (502, "a b c d e f g h " * 3), (503, "a b c d e f g h " * 2), (504, "a b " * 12 + "c d " * 12)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("work", [periodic_runs.WORK, 2_000, 40])
def test_whole_and_ranged_texts_equal_plain(repetitive, work):
    want = sorted((plain(*r) for r in repetitive.collect()), key=str)
    assert run(repetitive, work) == want
    assert sum(r[1] for r in want) > 100


def test_query_equals_plain(spark, documents):
    want = sorted((plain(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect() if len(r["text"] or "") < 9_000), key=str)
    got = [tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == documents.count() and set(want) <= set(got)


def test_odd_rows(spark, odd, none):
    """Nulls, blanks, repeats, long texts and clashing names; every row stays, and other columns pass."""
    docs = odd.withColumnRenamed("__id", "runs").selectExpr("*", "lang AS collapsed", "lang AS given", "lang AS `row`", "lang AS words")
    found, n_words, runs, collapsed = periodic_runs.find_runs(docs, work=1 << 24)
    rows = found.collect()
    assert found.columns[: len(docs.columns)] == docs.columns and len(rows) == docs.count() and len(set(found.columns)) == len(found.columns)
    by = {r["doc_id"]: r for r in rows}
    assert [(r["start"], r["length"], r["period"]) for r in by[8][runs]] == [(0, 30_000, 1)] and by[8][collapsed] == "word" and by[8]["runs"] == 7
    assert by[3][collapsed] == by[4][collapsed] == by[5][collapsed] == "" and by[3][n_words] == 0 and by[3]["text"] is None
    assert [r[n_words] for r in rows if r["doc_id"] == 7] == [2, 2]
    small = odd.where("doc_id != 8 OR doc_id IS NULL")
    assert run(small) == sorted((plain(r["doc_id"], r["text"]) for r in small.collect()), key=str)
    assert run(none) == []


def test_long_text_with_many_ids(spark):
    """Over 65,535 different words, with a run at the end."""
    text = " ".join(map(str, range(70_000))) + " p q r" * 9
    found, _, runs, _ = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), work=1 << 30)
    assert [tuple(r) for r in found.first()[runs]] == [(70_000, 27, 3)]
