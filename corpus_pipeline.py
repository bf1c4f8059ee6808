"""From ``documents`` to packed training sequences, in five stages.

Each stage takes what its predecessor kept and returns the columns of ``documents`` (``doc_id`` and ``text`` are needed, others pass unchanged, whatever their names), but for
the last, which returns packed pieces. An empty table passes every stage and gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import line_dedup, ngram_join, packing, quality_pu, toxicity
from hyperloom.llm.storage import fresh, materialize

#: Documents go from this toxicity score on, and stay from this quality score on.
TOXIC_FROM, GOOD_FROM = 0.5, 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are judged one by one: repeats and rows without an id like all others; null and empty texts have no evidence and stay. Without labels of both classes all stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "toxicity")
    return docs.withColumn(score, toxicity.score_column(model)).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are judged one by one, repeats and rows without an id like all others; null and empty texts have the features of no words. Without labels or unlabelled
    texts there is no model, and all stay."""
    (x,) = fresh(docs, "features")
    table = materialize(docs.withColumn(x, quality_pu.feature_column("text")), "scored-features")
    model = quality_pu.fit(table.select("doc_id", F.col(x).alias("x")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return table.where(quality_pu.probability(model, x) >= GOOD_FROM if model.fitted else F.lit(True)).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lose lines keep the rest (with ``n_chars``, if there, counted again); one that loses all its words goes. Null and empty texts, and rows without an
    id, stay as they are; rows that repeat an id with another text are documents of their own."""
    kept, _, removed = line_dedup.dedup_lines(docs)
    kept = kept.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return kept.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest id stays (of equal ids one of them); rows are documents of their own even where they repeat an id. Texts without words, and
    rows without an id, stay."""
    (row,) = fresh(docs, "row")
    table = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = ngram_join.near_duplicates(table.where("doc_id IS NOT NULL"), ident=row)
    found = materialize(found.select(F.col("doc_id").alias("member"), F.col("component_id").alias("component")), "near-duplicates")
    groups = found.where("member != component").select("component").distinct()
    ids = table.select(F.col("doc_id").alias("id"), F.col(row).alias("member"))
    members = found.join(groups, "component").join(ids, "member").select("component", F.struct("id", "member").alias("one"))
    kept = members.groupBy("component").agg(F.min("one").alias("first"))
    others = members.join(kept, "component").where("one != first").select(F.col("one.member").alias("other"))
    return table.join(others, table[row] == others["other"], "left_anti").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is packed, repeats and rows without an id too; null and empty texts are one piece, the end id."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_duplicates),
    ("best-fit packing", pack_sequences),
]

#: No stage's rows can be told in SQL: they follow from fitted models, fingerprints and token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
