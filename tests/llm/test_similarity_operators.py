"""Line dedup and the n-gram Jaccard join against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from hyperloom.llm import line_dedup, linkage, ngram_join, queries

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else ({tuple(words)} if words else set())


def brute_components(texts):
    ids = sorted(texts)
    sets = {i: shingles(texts[i]) for i in ids}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 85 * max(len(x), len(y)):
                shared = len(x & y)
                if 100 * shared >= 85 * (len(x) + len(y) - shared):
                    p, q = sorted((find(a), find(b)))
                    parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op10_ngram_jaccard(spark, SF).collect()}
    assert got == brute_components(texts)


@pytest.fixture(scope="module")
def families():
    """Originals with chains of edits, so that members far apart are linked only through others."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, ident = {}, 0
    for size in (60, 60, 120, 40, 5):
        words = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(40):
            texts[ident] = " ".join(words)
            ident += 1
            words = list(words)
            for _ in range(rng.choice((0, 1, 1, 2))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    passage = " ".join(rng.choice(vocabulary) for _ in range(55))
    for _ in range(80):
        texts[ident] = passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 5, 60))))
        ident += 1
    return texts


@pytest.mark.parametrize("part_size", [700, 25, 6])
def test_ngram_join_families(spark, families, monkeypatch, part_size):
    """Also with sets of many parts."""
    monkeypatch.setattr(ngram_join, "FREQUENT_IN", 30)
    monkeypatch.setattr(ngram_join, "part_counts", lambda n, num, den, parts=ngram_join.part_counts: parts(n * 700 // part_size, num, den))
    frame = spark.createDataFrame(list(families.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame).collect()}
    assert got == brute_components(families)


def test_ngram_join_odd_rows(odd, none):
    rows = ngram_join.near_duplicates(odd).collect()
    assert len(rows) == 11
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert by[3] == by[4][:1] + (3,) == (0, 3) and by[5] == (0, 5)
    assert by[6] == (1, 6) and by[7] == (1, 6) and by[None][1] is None
    assert ngram_join.near_duplicates(none).count() == 0


def test_repeated_keys_over_batch_ends(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(60), rng.randrange(30), rng.randrange(2)) for _ in range(150)] + [(99, k, 0) for k in range(40)] + [(100, 1, 0)] * 9
    distinct = set(rows)
    count = Counter(k for k, _, _ in distinct)
    wanted = sorted(r for r in distinct if count[r[0]] > 1)
    frame = spark.createDataFrame(rows, "key long, id long, slot int")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for rows_each in (1, 3, 10_000):
            spark.conf.set(size, rows_each)
            assert sorted(map(tuple, ngram_join.repeated_keys(frame).collect())) == wanted
    finally:
        spark.conf.set(size, before)


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(3)
    assert ngram_join.part_counts(10, 85, 100) == [1] and ngram_join.part_counts(600, 85, 100) == [1, 4] and ngram_join.part_counts(3000, 85, 100) == [16]
    vectors = rng.poisson(rng.choice([2, 5, 9], (400, 1)), (400, ngram_join.GROUPS))
    vectors[200:] = np.maximum(0, vectors[:200] + rng.integers(-1, 2, (200, ngram_join.GROUPS)) * (rng.random((200, ngram_join.GROUPS)) < 0.2))
    data = {"n": vectors.sum(axis=1), "c": vectors.astype(np.int32), "size": vectors.sum(axis=1)}
    near = ngram_join.near_points(85, 100)
    tree = ngram_join.CountTree(data, 85, 100)
    for i in range(400):
        want = np.flatnonzero(near(data, np.full(400, i), np.arange(400)))
        assert sorted(tree.search(i).tolist()) == want.tolist()


def test_chunks_of_large_components(spark):
    """Every pair of chunks meets: a chain over more members than a chunk stays one group."""
    rows = [(0, k, k) for k in range(57)] + [(1, 100 + k, 5 * k) for k in range(9)]
    frame = spark.createDataFrame(rows, "root long, id long, at long")
    placed = linkage.place_members(frame.select("id", "root"), chunk=10).join(frame.select("id", "at"), "id")

    def link(columns):
        at = columns["at"]
        return linkage.spread(len(at), lambda i, to: np.abs(at[to] - at[i]) == 1)

    got = {r["id"]: r["root"] for r in linkage.link_members(placed, link).collect()}
    assert got == {k: 0 for k in range(57)}


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["id"]: r["root"] for r in linkage.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}
    assert linkage.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))
        want = distance(a, b)
        for most in (0, 2, 5, 40):
            assert line_dedup.edit_distance(a, b, most) == min(want, most + 1)


def brute_lines(texts):
    """The kept text of each document by comparing all pairs of distinct lines."""
    where = {}
    for ident in sorted(texts):
        for pos, line in enumerate((texts[ident] or "").split("\n")):
            key = " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))
            if key and (len(key.split(" ")) >= line_dedup.MIN_WORDS or len(key) >= line_dedup.MIN_CHARS):
                where.setdefault(key, []).append((ident, pos))
    keys = list(where)
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            most = int((1 - line_dedup.SIMILARITY) * max(len(keys[i]), len(keys[j])) + 1e-9)
            if abs(len(keys[i]) - len(keys[j])) <= most and line_dedup.edit_distance(keys[i], keys[j], most) <= most:
                parent[find(i)] = find(j)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(find(i), []).extend(where[k])
    gone = {p for v in groups.values() for p in v if p != min(v)}
    return {i: None if t is None else "\n".join(x for pos, x in enumerate(t.split("\n")) if (i, pos) not in gone) for i, t in texts.items()}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x{'yz'[k % 2]}" for k in range(600)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 12, 60, 150)))) for _ in range(60)]
    texts = {}
    for ident in range(90):
        own = []
        for _ in range(rng.randrange(1, 9)):
            words = rng.choice(lines).split(" ")
            for _ in range(rng.choice((0, 0, 1, 2))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            own.append((" ".join(words)).capitalize() + rng.choice(("", ".", " 12!")))
        texts[ident] = "\n".join(own)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame)[0].collect()}
    assert got == brute_lines(texts)
    assert sum(map(len, got.values())) < 0.7 * sum(map(len, texts.values()))


def test_line_dedup_odd_rows(odd, none):
    rows = line_dedup.dedup_lines(odd)[0].collect()
    assert len(rows) == 11
    by = {r["doc_id"]: r["text"] for r in rows}
    assert by[1].startswith("The quick") and by[2] == "Another line that nobody else has in here."
    assert by[3] is None and by[4] == "" and by[5] == " \n\t \n" and by[None].startswith("The quick")
    assert all("__id" in r.asDict() and r["lang"] == "en" for r in rows if r["doc_id"] == 1)
    assert line_dedup.dedup_lines(none)[0].count() == 0


def test_line_dedup_of_repeated_ids(spark):
    """Rows that repeat an id with other texts lose only their own repeated lines; equal rows are one document."""
    one, other = "The quick brown fox jumps over the lazy dog today.", "Nobody else has this line of plain words in here."
    rows = [(1, one), (2, one), (2, other), (2, f"{other}\n{one}"), (3, other + " No"), (3, "short"), (3, "short"), (None, one), (4, other), (4, other)]
    got = sorted((tuple(r) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))[0].select("doc_id", "text").collect()), key=str)
    assert len(got) == len(rows) and got.count((4, "")) == 2 and got.count((3, "short")) == 2 and (None, one) in got and (1, one) in got and got.count((2, "")) == 2
    assert sum(other in t for i, t in got if i == 2) == 1


def test_ngram_join_of_repeated_ids(spark):
    """An id has the links of all its rows: brute force over ids."""
    base = " ".join(f"w{k}" for k in range(80))
    other = " ".join(f"v{k}" for k in range(80))
    rows = [(1, base), (5, base), (5, other), (7, other + " x"), (7, "alone as can be here"), (8, "alone as can be here"), (9, other + " x"), (10, ""), (5, None), (11, "one of a kind is this"), (11, "one of a kind is this")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    sets = [(i, {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} if t else set()) for i, t in rows]
    root = {i: i for i, _ in rows}
    for _ in rows:
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert got == sorted((i, len(s), root[i]) for i, s in sets) and root[9] == 1
