"""State and replies of a command log: last writer wins.

A log is a table with ``seq`` (the order of arrival) and parsed commands. Two semantics:
``documented``: the last mutation of a key before a command decides. ``observed``: a DELETE
acts on the open segment only, if the key was SET in it; needs ``segment_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.commands import ENTRY_OVERHEAD, reply

_BEFORE = (Window.unboundedPreceding, -1)


def mutations(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("cmd").isin("SET", "DELETE"))


def last_mutations(parsed: DataFrame) -> DataFrame:
    """``key, seq, value, tombstone`` of each key's last mutation: one shuffle, combined before it."""
    last = F.max(F.struct("seq", "value", (F.col("cmd") == "DELETE").alias("tombstone"))).alias("m")
    return mutations(parsed).groupBy("key").agg(last).select("key", "m.seq", "m.value", "m.tombstone")


def snapshot(parsed: DataFrame) -> DataFrame:
    """Keys that a GET would find now, with their values (an empty value is not found)."""
    return last_mutations(parsed).where(~F.col("tombstone") & (F.col("value") != "")).select("key", "value")


def tombstones(parsed: DataFrame) -> DataFrame:
    return last_mutations(parsed).where("tombstone").select("key", "seq")


def live_count(parsed: DataFrame) -> DataFrame:
    """Keys whose last mutation is a SET; an empty value counts."""
    return last_mutations(parsed).where(~F.col("tombstone")).agg(F.count(F.lit(1)).alias("live_keys"))


#: Commands of a key are ordered in chunks of this many sequence numbers (a power of two), so a hot key is many tasks' work.
CHUNK_BITS = 20


def responses(parsed: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """``seq, response`` of every command, documented semantics: an as-of lookup by window.

    The window is over a key's commands in one chunk of the log; what the chunks before say
    of the key is a row for each key and chunk, carried forward by a window over those rows.
    Rejected commands have no key and need no order; they stay out of the windows, where
    they would be one hot partition.
    """
    valid = parsed.where("valid").withColumn("chunk", F.shiftright("seq", chunk_bits))
    change = F.when(F.col("cmd") != "GET", F.struct("seq", "value"))
    closing = valid.groupBy("key", "chunk").agg(F.max(change).alias("closing"))
    carried = F.last("closing", ignorenulls=True).over(Window.partitionBy("key").orderBy("chunk").rowsBetween(*_BEFORE))
    seen = F.last(F.when(F.col("cmd") != "GET", F.col("value")), ignorenulls=True).over(Window.partitionBy("key", "chunk").orderBy("seq").rowsBetween(*_BEFORE))
    ops = valid.withColumn("seen", seen).join(closing.select("key", "chunk", carried.alias("carried")), ["key", "chunk"])
    answered = ops.select("seq", reply(F.col("cmd"), F.coalesce("seen", "carried.value")).alias("response"))
    return answered.unionByName(parsed.where(~F.col("valid")).select("seq", reply(F.col("cmd"), F.lit(None).cast("string")).alias("response")))


def segment_entries(ops: DataFrame, semantics: str = "observed") -> DataFrame:
    """``segment_id, key, value, tombstone``: what each segment holds of a key when it ends.

    Observed: only if the segment has a SET of the key; documented: also a lone DELETE.
    """
    last = F.max(F.struct("seq", "value", (F.col("cmd") == "DELETE").alias("tombstone"))).alias("m")
    groups = mutations(ops).groupBy("segment_id", "key").agg(last, F.max((F.col("cmd") == "SET").cast("int")).alias("sets"))
    if semantics == "observed":
        groups = groups.where("sets = 1")
    return groups.select("segment_id", "key", F.when(~F.col("m.tombstone"), F.col("m.value")).alias("value"), F.col("m.tombstone").alias("tombstone"))


def newest_entries(entries: DataFrame) -> DataFrame:
    """Of each key the entry of the newest segment, tombstones included: the merge of a compaction."""
    newest = F.max(F.struct("segment_id", "value", "tombstone")).alias("e")
    return entries.groupBy("key").agg(newest).select("key", "e.segment_id", "e.value", "e.tombstone")


def snapshot_observed(ops: DataFrame) -> DataFrame:
    return newest_entries(segment_entries(ops)).where(~F.col("tombstone") & (F.col("value") != "")).select("key", "value")


def responses_observed(parsed: DataFrame, segments: DataFrame) -> DataFrame:
    """``seq, response`` under observed semantics; ``segments``: ``seq, segment_id``.

    What the open segment says, if it has a SET of the key before the command, comes from a
    window over the key's commands in the segment; else the newest earlier segment with an
    entry decides, which is carried forward over a row for each key and segment.
    """
    ops = parsed.where("valid").join(segments, "seq")
    change = F.when(F.col("cmd") != "GET", F.col("value"))
    before = Window.partitionBy("key", "segment_id").orderBy("seq").rowsBetween(*_BEFORE)
    last = F.max(F.when(F.col("cmd") != "GET", F.struct("seq", "value")))
    closing = ops.groupBy("key", "segment_id").agg(F.when(F.max(F.col("cmd") == "SET"), last).alias("closing"))
    stored = F.last("closing", ignorenulls=True).over(Window.partitionBy("key").orderBy("segment_id").rowsBetween(*_BEFORE))
    opened = ops.withColumns({"open_sets": F.coalesce(F.sum((F.col("cmd") == "SET").cast("int")).over(before), F.lit(0)), "open_value": F.last(change, ignorenulls=True).over(before)})
    opened = opened.join(closing.select("key", "segment_id", stored.alias("stored")), ["key", "segment_id"])
    found = F.when(F.col("open_sets") > 0, F.col("open_value")).otherwise(F.col("stored.value"))
    answered = opened.select("seq", reply(F.col("cmd"), found).alias("response"))
    return answered.unionByName(parsed.where(~F.col("valid")).select("seq", reply(F.col("cmd"), F.lit(None).cast("string")).alias("response")))


def recovered_bytes(replayed: DataFrame) -> DataFrame:
    """``log_id, bytes``: what replaying a log adds to the write counter. Replayed DELETEs add nothing, unlike live ones."""
    own = F.when(F.col("cmd") == "SET", F.octet_length("key") + F.octet_length("value") + ENTRY_OVERHEAD).otherwise(0)
    return replayed.groupBy("log_id").agg(F.sum(own.cast("long")).alias("bytes"))


def entries_size(entries: DataFrame) -> DataFrame:
    """``n, bytes`` that entries (``key, value``) take in memory, each counted once."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + ENTRY_OVERHEAD
    return entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def get(parsed: DataFrame, key: str | Column) -> DataFrame:
    """One key now: the filter is pushed below the aggregate to the scan."""
    own = last_mutations(parsed.where(F.col("key") == key))
    return own.select("key", reply(F.lit("GET"), F.when(~F.col("tombstone"), F.col("value"))).alias("response"))


def multi_get(state: DataFrame, probes: DataFrame) -> DataFrame:
    """A row for each probe key, with the value or NOT_FOUND."""
    return probes.select("key").distinct().join(state, "key", "left").select("key", reply(F.lit("GET"), F.col("value")).alias("response"))


def existing(state: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.select("key").distinct().join(state, "key", "left_semi")


def missing(state: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.select("key").distinct().join(state, "key", "left_anti")


def scan_range(state: DataFrame, low: str, high: str) -> DataFrame:
    """Keys from ``low`` up to, not including, ``high`` (an addition; byte order)."""
    return state.where((F.col("key") >= low) & (F.col("key") < high)).orderBy("key")
