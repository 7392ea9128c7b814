"""The layout of sorted table files as relations: sizes, offsets, sparse index, footer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.codec import bloom_columns, entry_bytes

DATA_START, FOOTER, INDEX_EVERY = 12, 40, 16


def entry_layout(entries: DataFrame) -> DataFrame:
    """``segment_id, ordinal, key, entry_size, entry_offset`` in key order."""
    by_key = Window.partitionBy("segment_id").orderBy("key")
    sized = entries.withColumn("entry_size", entry_bytes(F.col("key"), F.col("value"), F.col("tombstone")))
    before = F.coalesce(F.sum("entry_size").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.select("segment_id", (F.row_number().over(by_key) - 1).cast("long").alias("ordinal"), "key", "entry_size", (before + DATA_START).cast("long").alias("entry_offset"))


def sparse_index(layout: DataFrame, every: int = INDEX_EVERY) -> DataFrame:
    return layout.where(F.col("ordinal") % every == 0).select("segment_id", "key", "entry_offset")


def metadata(layout: DataFrame, every: int = INDEX_EVERY) -> DataFrame:
    """Footer, statistics and file size of each segment: one aggregation, partly combined before the shuffle."""
    m, k = bloom_columns(F.col("entry_count"))
    index_bytes = F.when(F.col("ordinal") % every == 0, F.lit(12) + F.octet_length("key")).otherwise(0)
    out = layout.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("entry_count"), F.sum("entry_size").alias("data_bytes"), F.sum(index_bytes).alias("index_bytes"), F.min("key").alias("min_key"), F.max("key").alias("max_key")
    )
    out = out.withColumns({"bloom_bits": m, "bloom_hashes": k, "data_end": F.col("data_bytes") + DATA_START})
    out = out.withColumn("index_offset", (F.col("data_end") + 5 + F.ceil(F.col("bloom_bits") / 8)).cast("long"))
    size = (F.col("index_offset") + 4 + F.col("index_bytes") + FOOTER).cast("long")
    return out.select("segment_id", "entry_count", "data_end", "index_offset", size.alias("file_size"), "min_key", "max_key")


def bloom_parameters(entries: DataFrame) -> DataFrame:
    m, k = bloom_columns(F.col("n"))
    out = entries.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"m": m, "k": k})
    return out.select("segment_id", "n", "m", "k", (5 + F.ceil(F.col("m") / 8)).cast("long").alias("section_bytes"))


def sparse_seek(index: DataFrame, probes: DataFrame) -> DataFrame:
    """For probes (``probe_id, segment_id, key``): offset of the greatest index key not above the key.

    An as-of join by one sort: index rows and probes of a segment in key order, the last
    index row carried forward. Null if the key is below the first one.
    """
    rows = index.select("segment_id", "key", F.lit(0).alias("kind"), "entry_offset", F.lit(None).cast("long").alias("probe_id")).unionByName(
        probes.select("segment_id", "key", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("entry_offset"), "probe_id")
    )
    forward = Window.partitionBy("segment_id").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("seek_offset", F.last("entry_offset", ignorenulls=True).over(forward)).where("kind = 1").select("probe_id", "segment_id", "key", "seek_offset")


def lookup_cost(layout: DataFrame, probes: DataFrame, every: int = INDEX_EVERY) -> DataFrame:
    """Entries that a lookup reads for probes (``probe_id, segment_id, key``): from the index position to the hit or the first greater key."""
    by_key = Window.partitionBy("segment_id").orderBy("key", "kind")
    rows = layout.select("segment_id", "key", F.lit(0).alias("kind"), "ordinal", F.lit(None).cast("long").alias("probe_id")).unionByName(
        probes.select("segment_id", "key", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("ordinal"), "probe_id")
    )
    prior = F.last("ordinal", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    prior_key = F.last(F.when(F.col("kind") == 0, F.col("key")), ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    most = F.max("ordinal").over(Window.partitionBy("segment_id"))
    rows = rows.withColumns({"prior": prior, "prior_key": prior_key, "most": most}).where("kind = 1")
    hit = F.col("prior_key") == F.col("key")
    read = F.col("prior") - F.col("prior") % every
    past = F.least(F.col("prior") + F.when(hit, 0).otherwise(1), F.col("most"))
    return rows.select("probe_id", "segment_id", "key", F.coalesce(hit, F.lit(False)).alias("hit"), F.coalesce(past - read + 1, F.lit(0)).alias("entries_read"))
