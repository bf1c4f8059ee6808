"""URL lists with dates: which entries were active when a page was fetched.

Dated list events (an entry is added or removed) become validity intervals, one sorted array for each entry, so that a
capture meets an entry once, however often the entry changed. Each capture is tested under its host and every parent domain.

An interval holds its first instant and not its last. Of several events of an entry at the same instant, removal wins. Removing what
is not listed does nothing, and adding what is listed neither. Null urls have no host and match nothing; captures without a time match nothing. Captures come back once each,
repeated rows included. Empty lists block nothing, empty captures give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.llm.storage import materialize

#: User names are skipped, ports cut off, IPv6 addresses whole with their brackets.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"


def with_host(captures: DataFrame, url: str = "url") -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))
    return captures.withColumn("host", F.when(host != "", host))


def intervals(events: DataFrame) -> DataFrame:
    """(entry, spans): events (entry, at, action 'add' or 'remove') as sorted arrays of (valid_from, valid_to); an open end is null."""
    one = events.where("entry IS NOT NULL AND at IS NOT NULL").groupBy("entry", "at").agg(F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("listed"))
    order = Window.partitionBy("entry").orderBy("at")
    changes = one.withColumn("was", F.coalesce(F.lag("listed").over(order), F.lit(0))).where("listed != was")
    spans = changes.withColumn("until", F.lead("at").over(order)).where("listed = 1")
    return spans.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("valid_from"), F.col("until").alias("valid_to")))).alias("spans"))


def active_entries(captures: DataFrame, lists: DataFrame, ident: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """(id, host, fetched, n_active, first_entry): how many entries were active for the capture then, and the smallest of them."""
    # Numbered once and written: both uses below have to see the same numbers, also where a task of ``captures`` is run again.
    numbered = with_host(captures.select(F.col(ident).alias("id"), F.col(url).alias("url"), F.col(fetched).alias("at")), "url").select("id", "host", "at", F.monotonically_increasing_id().alias("capture"))
    hosts = materialize(numbered, "captures")
    parts = F.split("host", r"\.")
    names = hosts.where("host IS NOT NULL").select(
        "capture", "at", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("entry")
    )
    alive = F.exists("spans", lambda s: (s["valid_from"] <= F.col("at")) & (s["valid_to"].isNull() | (s["valid_to"] > F.col("at"))))
    hits = names.join(lists.select("entry", "spans"), "entry").where(alive).groupBy("capture").agg(F.count("*").alias("n_active"), F.min("entry").alias("first_entry"))
    return hosts.join(hits, "capture", "left").select(F.col("id").alias(ident), "host", F.col("at").alias(fetched), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "first_entry")
