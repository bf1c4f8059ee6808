"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import audio, bpe, gru_lm, line_dedup, ngram_join, packing, periodic_runs, prefix_trie, quality_pu, quality_rules, toxicity, url_lists, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)[0].select("doc_id", "text", "n_lines", "n_removed")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packing.pack(cut)


def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_digests(audio.store_pcm(audio.store_text_media(_table(spark, sf_dir, "documents"))))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(encoded, ranks))


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.revisits(_table(spark, sf_dir, "pages"))
    records = warc.read_archives(warc.convert_archives(warc.arc_archives(pages)))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.score_column(model).alias("score"))
    return scored.select("*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


#: Dated list events: each host of the pages is added on a day and, half of them, removed later, both by its MD5.
_DAY = "DATE '2000-01-01'"


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr("TIMESTAMP '2000-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(page_id % 10000000 AS INT), 0)").alias("fetched"))
    hosts = url_lists.with_host(captures).where("host IS NOT NULL").select("host").distinct()
    hashed = hosts.select("host", F.expr("CAST(conv(substring(md5(host), 1, 4), 16, 10) AS INT)").alias("h"), F.expr("substring_index(host, '.', -3)").alias("entry"))
    days = hashed.select("entry", F.col("h").alias("h"))
    add = days.select("entry", F.expr("TIMESTAMP '2000-01-01 00:00:00' + make_interval(0, 0, 0, h % 20, 0, 0, 0)").alias("at"), F.lit("add").alias("action"))
    drop = days.where("h % 2 = 0").select("entry", F.expr("TIMESTAMP '2000-01-01 00:00:00' + make_interval(0, 0, 0, h % 20 + 1 + h % 7, 0, 0, 0)").alias("at"), F.lit("remove").alias("action"))
    hits = url_lists.active_entries(captures, url_lists.intervals(add.union(drop)))
    return hits.select("page_id", "host", F.date_format("fetched", "yyyy-MM-dd HH:mm:ss").alias("fetched"), "n_active", "first_entry", (F.col("n_active") > 0).alias("blocked"))


_OP8_SQL = r"""
WITH captures AS (
  SELECT row_number() OVER () AS capture, page_id, nullif(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1)), '') AS host,
         TIMESTAMP '2000-01-01 00:00:00' + to_minutes(page_id % 10000000) AS fetched FROM pages),
hosts AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 4))::INT AS h, string_split(host, '.') AS p FROM captures WHERE host IS NOT NULL),
entries AS (SELECT array_to_string(p[greatest(1, len(p) - 2):], '.') AS entry, h FROM hosts),
events AS (
  SELECT entry, TIMESTAMP '2000-01-01 00:00:00' + to_days(h % 20) AS ts, 1 AS listed FROM entries
  UNION ALL SELECT entry, TIMESTAMP '2000-01-01 00:00:00' + to_days(h % 20 + 1 + h % 7), 0 FROM entries WHERE h % 2 = 0),
one AS (SELECT entry, ts, min(listed) AS listed FROM events GROUP BY ALL),
names AS (SELECT capture, fetched, array_to_string(p[k:], '.') AS entry FROM (
  SELECT capture, fetched, string_split(host, '.') AS p, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM captures WHERE host IS NOT NULL)),
state AS (SELECT n.capture, n.entry, arg_max(o.listed, o.ts) AS listed FROM names n JOIN one o ON o.entry = n.entry AND o.ts <= n.fetched GROUP BY ALL),
hits AS (SELECT capture, count(*) AS n, min(entry) AS first_entry FROM state WHERE listed = 1 GROUP BY capture)
SELECT page_id, host, strftime(fetched, '%Y-%m-%d %H:%M:%S') AS fetched, coalesce(n, 0)::BIGINT AS n_active, first_entry, coalesce(n, 0) > 0 AS blocked
FROM captures LEFT JOIN hits USING (capture)
"""


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = quality_pu.feature_table(_table(spark, sf_dir, "documents"))
    model = quality_pu.fit(table, _table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    scored = table.select("doc_id", held.alias("held_out"), quality_pu.probability(model).alias("score"))
    return scored.select("*", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"), shared_heads=True)


#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda crc, b: list_reduce([xor(crc, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

_OP11_SQL = f"""
WITH given AS (
  SELECT conv_id AS c, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list(turn ORDER BY k) AS ts FROM given GROUP BY c),
hashed AS (SELECT c, ts, {_CRC} % 9 AS h FROM lists),
built AS (
  SELECT x.c, coalesce(s.ts[1:x.h], []) || x.ts[x.h + 1:] AS ts FROM hashed x LEFT JOIN lists s ON s.c = x.c - x.c % 5),
members AS (SELECT c, ts[1:d] AS seq, d, len(ts) AS length FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM built)),
nodes AS (
  SELECT seq, d, min(c) AS rep, count(*) AS n, max(length) = d AS leaf, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (length = d), '') AS ends,
         CASE WHEN d > 0 THEN (count(*) - 1) * octet_length(encode(seq[d].t)) ELSE 0 END AS saved
  FROM members GROUP BY seq, d),
above AS (SELECT d, leaf, saved, seq[1:a] AS seq FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM nodes)),
sums AS (SELECT seq, count(*) FILTER (leaf) AS leaves, sum(saved) AS saved FROM above GROUP BY seq),
kids AS (SELECT seq[1:d - 1] AS seq, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL)
SELECT o.rep AS conv_id, o.d::BIGINT AS depth, p.rep AS parent_conv_id, o.n AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM nodes o JOIN sums s ON s.seq = o.seq LEFT JOIN kids k ON k.seq = o.seq LEFT JOIN nodes p ON o.d > 0 AND p.d = o.d - 1 AND p.seq = o.seq[1:o.d - 1]
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_tails(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found, _, runs, collapsed = periodic_runs.find_runs(docs)
    return periodic_runs.digests(found, runs, collapsed)


def op13_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text")
    model = gru_lm.fit(docs, ~F.col("held_out"))
    scored, *_ = gru_lm.score(docs, model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")


_OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, url FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper IS DISTINCT FROM page_id AND keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to FROM k
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_quality_rules, op3_best_fit_packing, op4_telephony_audio, op5_byte_bpe, op6_arc_to_warc, op7_toxicity, op8_url_lists, op9_quality_classifier, op10_ngram_jaccard, op11_prefix_trie, op12_periodic_runs, op13_gru_lm)
}
ORACLES: dict[str, str] = {"op2_quality_rules": quality_rules.oracle(), "op6_arc_to_warc": _OP6_SQL, "op8_url_lists": _OP8_SQL, "op11_prefix_trie": _OP11_SQL}
