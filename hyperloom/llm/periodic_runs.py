"""Periodic runs of words, found by comparing a text's word ids with themselves at every lag.

A run is a stretch of consecutive words whose smallest period is q (words q apart are equal), of at least ``max(MIN_WORDS, MIN_TIMES * q)`` words, that
neither neighbour extends keeping period q. For each lag q up to n / ``MIN_TIMES`` the id array is compared with itself shifted by q; true stretches of
``max(MIN_WORDS, MIN_TIMES * q) - q`` or more are runs of period q. A stretch at a multiple of its smallest period has the same bounds as at this period (two periods
of a stretch at least as long as their sum have their greatest common divisor as a period), so of equal bounds the smallest lag stays.

Spark spreads texts, and of texts of over ``WORK`` comparisons the ranges of lags: each range is a row of its own, dealt out anew, and the runs of a text come
together again by bounds. A text's comparisons grow with the square of its words; a range's do not.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts, and texts of separators alone, have no runs and collapse to the empty string. Every row is one text: equal rows and
rows that repeat an id give equal results each, rows without an id are kept. Other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.llm.storage import fresh, materialize

MIN_WORDS, MIN_TIMES = 24, 3
#: Comparisons (words times lags) that one row of work holds.
WORK = 1 << 26
#: Comparisons held as an array at once.
BLOCK = 1 << 17

RUN = "struct<start:bigint,length:bigint,period:bigint>"
FOUND = f"n_words bigint, runs array<{RUN}>, collapsed string"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, in the narrowest type that leaves two values unused."""
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for w in words]
    return np.array(ids, np.uint16 if len(known) < 65_534 else np.uint32)


def scan(ids: np.ndarray, low: int, high: int) -> np.ndarray:
    """Rows (start, length, lag) of the maximal stretches of equal words at the lags low..high-1 that are long enough."""
    n = len(ids)
    high = min(high, n // MIN_TIMES + 1)
    none, never = np.iinfo(ids.dtype).max, np.iinfo(ids.dtype).max - 1  # beyond the end nothing is equal
    found = []
    lag = low
    while lag < high:
        many = min(high - lag, max(1, BLOCK // n))
        width = n - lag
        eights = -(-width // 8)
        fixed = np.concatenate([ids[:width], np.full(8 * eights - width, never, ids.dtype)])
        moved = np.concatenate([ids[lag:], np.full(8 * eights - width + many - 1, none, ids.dtype)])
        equal = np.lib.stride_tricks.sliding_window_view(moved, 8 * eights) == fixed
        # The shortest stretch that any lag asks for has 16 words, so it fills one of the eights of cells.
        for k in np.flatnonzero((equal.view(np.uint64) == 0x0101010101010101).any(axis=1)):
            q = lag + int(k)
            line = np.zeros(width + 2, np.int8)
            line[1:-1] = equal[k, :width]
            turns = np.flatnonzero(np.diff(line))
            start, size = turns[::2], turns[1::2] - turns[::2] + q
            long = size >= max(MIN_WORDS, MIN_TIMES * q)
            found.append(np.stack([start[long], size[long], np.full(int(long.sum()), q)], axis=1))
        lag += many
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def smallest_periods(stretches: np.ndarray) -> np.ndarray:
    """Of stretches with equal bounds the one of the smallest lag, by start, then lag."""
    ordered = stretches[np.lexsort((stretches[:, 2], stretches[:, 1], stretches[:, 0]))]
    first = np.ones(len(ordered), bool)
    first[1:] = (ordered[1:, :2] != ordered[:-1, :2]).any(axis=1)
    ordered = ordered[first]
    return ordered[np.lexsort((ordered[:, 2], ordered[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside all runs, and of each run those of its first period that no other run drops, joined by one space."""
    if len(runs) == 0:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0))


def spreads(n: int, work: int) -> bool:
    """Whether a text of n words is cut into ranges of lags."""
    return n * (n // MIN_TIMES) > work


def _per_row(out: T.StructType, given: str, make: Callable[[list[bytes], dict], dict | None]) -> Callable:
    """A function over batches: the other columns of each row beside what ``make(words, row)`` gives; none for no dictionary. ``given``: the column of the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept, made = batch.column(given), [], []
            others = [c for c in batch.schema.names if c != given]
            size = 0
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").split()
                new = make(words, {c: batch.column(c)[i].as_py() for c in others if c in ("low", "high", "runs")})
                if new is not None:
                    kept.append(i)
                    made.append(new)
                    size += len(new.get("collapsed") or b"")
                if size > 1 << 24:
                    yield _joined(batch, others, kept, made, out)
                    kept, made, size = [], [], 0
            if kept:
                yield _joined(batch, others, kept, made, out)

    return run


def _joined(batch: pa.RecordBatch, others: list[str], kept: list[int], made: list[dict], out: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)
    rows = pa.array(kept, pa.int64())
    arrays = [batch.column(f.name).take(rows) if f.name in others and f.name not in made[0] else pa.array([m[f.name] for m in made], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _finished(words: list[bytes], runs: np.ndarray) -> dict:
    return {"n_words": len(words), "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], "collapsed": collapse(words, runs).decode("utf-8", "replace")}


def find_runs(docs: DataFrame, text: str = "text", work: int = WORK) -> tuple[DataFrame, str, str, str]:
    """``docs`` with three more columns, and their names: number of words (long), runs (array of start, length, period; by start, then period) and the
    text without the repeats of its runs (the words that stay, joined by one space; never null)."""
    names = fresh(docs, "n_words", "runs", "collapsed")
    # Inside, columns have names of their own: 0, 1, ... for those given, so that none clashes.
    numbered = docs.select(*(F.col(f"`{c}`").alias(str(k)) for k, c in enumerate(docs.columns)), F.col(f"`{text}`").cast("binary").alias("given"))
    passing = T.StructType([f for f in numbered.schema.fields if f.name != "given"])
    found = T._parse_datatype_string(FOUND)

    def whole(words: list[bytes], _: dict) -> dict | None:
        n = len(words)
        if spreads(n, work):
            return None
        ids = word_ids(words) if n >= MIN_WORDS else np.zeros(0, np.uint16)
        return _finished(words, smallest_periods(scan(ids, 1, n // MIN_TIMES + 1)) if n >= MIN_WORDS else np.zeros((0, 3), np.int64))

    out = T.StructType(passing.fields + found.fields)
    short = numbered.mapInArrow(_per_row(out, "given", whole), out)

    # A text that is cut has more words, and thus bytes, than this.
    least = int(2 * (MIN_TIMES * work) ** 0.5) - 1
    long = numbered.where(F.octet_length("given") >= least).withColumn("row", F.monotonically_increasing_id())
    cut = T.StructType([*long.select(*passing.names, "row").schema.fields, T.StructField("words", T.BinaryType()), T.StructField("n", T.LongType())])
    long = materialize(long.mapInArrow(_per_row(cut, "given", lambda words, _: {"words": b" ".join(words), "n": len(words)} if spreads(len(words), work) else None), cut), "run-texts")
    each = F.greatest(F.lit(1), F.floor(F.lit(work) / F.col("n")))
    ranges = long.select("row", "words", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("n") / MIN_TIMES), each)).alias("low"), each.alias("each"))
    ranges = ranges.select("row", "words", "low", (F.col("low") + F.col("each")).alias("high")).repartition("row", "low")
    spans = T._parse_datatype_string(f"row bigint, found array<{RUN}>")

    def part(words: list[bytes], row: dict) -> dict:
        return {"found": [dict(zip(("start", "length", "period"), r, strict=True)) for r in scan(word_ids(words), row["low"], row["high"]).tolist()]}

    stretches = ranges.select("row", "low", "high", F.col("words").alias("given")).mapInArrow(_per_row(spans, "given", part), spans)
    runs = stretches.select("row", F.explode("found").alias("r")).groupBy("row", "r.start", "r.length").agg(F.min("r.period").alias("period"))
    runs = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("r"))
    runs = runs.select("row", F.transform("r", lambda x: F.struct(x["start"], x["length"], x["period"])).alias("runs"))
    joined = long.join(runs, "row", "left").select(*passing.names, F.coalesce("runs", F.array().cast(f"array<{RUN}>")).alias("runs"), F.col("words").alias("given"))

    def last(words: list[bytes], row: dict) -> dict:
        return _finished(words, np.array([[r["start"], r["length"], r["period"]] for r in row["runs"]], np.int64).reshape(-1, 3))

    full = short.unionByName(joined.mapInArrow(_per_row(out, "given", last), out))
    pairs = [*((str(k), c) for k, c in enumerate(docs.columns)), *zip(("n_words", "runs", "collapsed"), names, strict=True)]
    return full.select(*(F.col(a).alias(b) for a, b in pairs)), *names


def longest(runs: str) -> Column:
    """The run of the greatest length over period; of equal ones that of the smallest start, then period. Null without runs."""
    return F.expr(
        f"element_at(array_sort(`{runs}`, (a, b) -> CASE WHEN a.length * b.period > b.length * a.period THEN -1 WHEN a.length * b.period < b.length * a.period THEN 1 "
        "WHEN a.start != b.start THEN CASE WHEN a.start < b.start THEN -1 ELSE 1 END WHEN a.period < b.period THEN -1 WHEN a.period > b.period THEN 1 ELSE 0 END), "
        f"CASE WHEN size(`{runs}`) > 0 THEN 1 ELSE NULL END)"
    )


def digests(found: DataFrame, runs: str, collapsed: str) -> DataFrame:
    """doc_id, n_runs, the greatest run's start, length, period and exponent_milli (null without runs), and SHA-256 of all runs and of the collapsed text."""
    best = found.select("doc_id", F.col(runs).alias("runs"), F.col(collapsed).alias("collapsed"), longest(runs).alias("best"))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts of a tenth of the ids (unsigned CRC-32 h of the decimal id divisible by 10) made periodic from a word on: with g = h div 10, word i >= a becomes
    word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8). Rows without an id stay."""
    h, words, n, g, a, p = fresh(docs, "h", "words", "n", "g", "a", "p")
    hashed = docs.withColumn(h, F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY))"))
    hit = F.col(h) % 10 == 0
    cut = hashed.withColumn(words, F.when(hit, F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    cut = cut.withColumn(n, F.size(words).cast("long")).withColumn(g, F.expr(f"{h} div 10"))
    cut = cut.withColumn(a, F.when(F.col(n) > 0, F.col(g) % F.col(n))).withColumn(p, F.expr(f"1 + ({n} - {a}) div (3 + {g} % 8)"))
    # Whole periods until n - a words are there; no lambda, which would cut the text into words again for each of them.
    tail = F.expr(f"array_join(concat(slice({words}, 1, int({a})), slice(flatten(array_repeat(slice({words}, int({a}) + 1, int({p})), int(({n} - {a}) div {p}) + 1)), 1, int({n} - {a}))), ' ')")
    return cut.withColumn("text", F.when(hit & (F.col(n) > 0), tail).otherwise(F.col("text"))).select(docs.columns)
