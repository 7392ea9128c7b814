"""The catalogue of queries over the canonical command log: a callable and DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.codec import frame, unframe, wal_record
from tidemark.functions.hashing import Bloom
from tidemark.operators import changelog, layout, segments
from tidemark.sources import sst
from tidemark.sources.logs import event_commands, parsed_events, read_wal, read_wal_files, write_images
from tidemark.sources.scratch import scratch_path
from tidemark.sources.store import SegmentStore
from tidemark.streaming.state import run_to_table, stored_state, stream_folder

#: The queries' flush threshold: the tables' logs are too small for the default of 4 MiB.
FLUSH = 16384


@dataclass
class Log:
    """The canonical command log, parsed and cut into segments once for all that a query asks of it."""

    parsed: DataFrame
    placed: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Log:
        parsed = parsed_events(spark, sf_dir)
        return cls(parsed, segments.segments(parsed, FLUSH))

    @property
    def ops(self) -> DataFrame:
        return self.parsed.where("valid").join(self.placed, "seq")

    def table(self, final_flush: bool) -> DataFrame:
        return segments.segment_table(self.parsed, self.placed, FLUSH, final_flush)

    @property
    def entries(self) -> DataFrame:
        """Entries of all segments after shutdown (which flushes the last one)."""
        return changelog.segment_entries(self.ops)

    @property
    def layout(self) -> DataFrame:
        return layout.entry_layout(self.entries)

    @property
    def probes(self) -> DataFrame:
        """Every GET, in the newest segment flushed before it."""
        gets = self.ops.where("cmd = 'GET' AND segment_id > 0")
        return gets.select(F.col("seq").alias("probe_id"), (F.col("segment_id") - 1).alias("segment_id"), "key")

    @property
    def wal_images(self) -> DataFrame:
        """The write-ahead log of each segment, which its flush would truncate."""
        record = F.hex(wal_record(F.col("cmd"), F.col("key"), F.col("value")))
        records = changelog.mutations(self.ops).groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("seq", record.alias("r")))).alias("rs"))
        return records.select(F.col("segment_id").alias("log_id"), F.unhex(F.array_join(F.transform("rs", lambda x: x["r"]), "")).alias("content"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("key"))
    return keys


def cmd_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_events(spark, sf_dir).select("seq", "cmd", "key", "value", "valid", F.col("reject_code").cast("int").alias("reject_code"))


def cmd_reject_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_events(spark, sf_dir).groupBy(F.col("reject_code").cast("int").alias("reject_code"), "cmd").agg(F.count(F.lit(1)).alias("n"))


def kv_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.responses(parsed_events(spark, sf_dir))


def kv_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.snapshot(parsed_events(spark, sf_dir))


def kv_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.tombstones(parsed_events(spark, sf_dir))


def kv_live_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.live_count(parsed_events(spark, sf_dir))


def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.get(parsed_events(spark, sf_dir), "user7")


def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.multi_get(kv_snapshot(spark, sf_dir), _customers(spark, sf_dir))


def kv_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.existing(kv_snapshot(spark, sf_dir), _customers(spark, sf_dir))


def kv_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.missing(kv_snapshot(spark, sf_dir), _customers(spark, sf_dir))


def kv_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.scan_range(kv_snapshot(spark, sf_dir), "user1", "user2")


def mem_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Log.of(spark, sf_dir).placed.select("seq", "mem_bytes")


def kv_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Log.of(spark, sf_dir).table(False)


def memtable_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the segment that no flush has closed."""
    log = Log.of(spark, sf_dir)
    entries = log.entries.join(log.table(False).where("NOT flushed").select("segment_id"), "segment_id", "left_semi")
    return entries.select("key", "value", "tombstone").orderBy("key")


def memtable_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the open segment and the memory they take, each counted once."""
    return changelog.entries_size(memtable_snapshot(spark, sf_dir))


def sst_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Log.of(spark, sf_dir).entries


def kv_responses_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = Log.of(spark, sf_dir)
    return changelog.responses_observed(log.parsed, log.placed.select("seq", "segment_id"))


def kv_snapshot_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.snapshot_observed(Log.of(spark, sf_dir).ops)


def level_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.level_layout(Log.of(spark, sf_dir).table(False))


def table_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each level after the last flush."""
    last = level_layout(spark, sf_dir).agg(F.max(F.struct("segment_id", "l0_files", "l1_files")).alias("f")).select("f.*")
    return last.select(F.col("l0_files").cast("long").alias("l0_files"), "l1_files", (F.col("l0_files") + F.col("l1_files")).cast("long").alias("tables"))


def compaction_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.newest_entries(Log.of(spark, sf_dir).entries)


def read_path_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a GET of each key that was ever looked up ends: memtable, L0, L1 or nowhere."""
    log = Log.of(spark, sf_dir)
    keys = log.parsed.where("cmd = 'GET'").select("key").distinct()
    newest = changelog.newest_entries(log.entries).select("key", "segment_id", "tombstone")
    places = segments.level_layout(log.table(False)).select("segment_id", F.concat(F.lit("L"), F.col("level").cast("string")).alias("place"))
    found = newest.join(places, "segment_id", "left").select("key", "segment_id", "tombstone", F.coalesce("place", F.lit("memtable")).alias("place"))
    return keys.join(found, "key", "left").select("key", F.coalesce("place", F.lit("none")).alias("place"), "segment_id", F.coalesce("tombstone", F.lit(False)).alias("tombstone"))


def sst_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Log.of(spark, sf_dir).layout


def sst_sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.sparse_index(sst_layout(spark, sf_dir))


def sst_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.metadata(sst_layout(spark, sf_dir))


def sparse_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = Log.of(spark, sf_dir)
    return layout.sparse_seek(layout.sparse_index(log.layout), log.probes)


def lookup_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = Log.of(spark, sf_dir)
    return layout.lookup_cost(log.layout, log.probes)


def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.bloom_parameters(Log.of(spark, sf_dir).entries)


def bloom_no_false_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each segment's own keys, how many its bloom filter denies."""

    def probe(g: pd.DataFrame) -> pd.DataFrame:
        keys = [k.encode() for k in g["key"]]
        bloom = Bloom.from_bytes(Bloom.build(keys).to_bytes())
        return pd.DataFrame({"segment_id": [g["segment_id"].iloc[0]], "n_keys": [len(keys)], "denied": [int(np.sum(~bloom.might_contain(keys)))]})

    return Log.of(spark, sf_dir).entries.select("segment_id", "key").groupBy("segment_id").applyInPandas(probe, "segment_id long, n_keys long, denied long")


def wal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = changelog.mutations(parsed_events(spark, sf_dir))
    return ops.select("seq", F.hex(wal_record(F.col("cmd"), F.col("key"), F.col("value"))).alias("record"))


def wal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_wal(Log.of(spark, sf_dir).wal_images)


def wal_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay of all logs: the state that recovery arrives at."""
    replayed = read_wal(Log.of(spark, sf_dir).wal_images).withColumn("seq", F.struct("log_id", "ordinal"))
    return changelog.snapshot(replayed)


def wal_recover_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replaying each log adds to the write counter."""
    return changelog.recovered_bytes(read_wal(Log.of(spark, sf_dir).wal_images))


def wal_files_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs written as files, found by their names and replayed in that order."""
    folder = scratch_path(spark, "wal-files")
    images = Log.of(spark, sf_dir).wal_images.withColumn("name", F.format_string("wal-%08d", "log_id"))
    write_images(images, folder)
    return changelog.snapshot(read_wal_files(spark, folder).withColumn("seq", F.struct("log_id", "ordinal")))


def sst_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment as a table file and read back."""
    return sst.read_tables(sst.table_images(Log.of(spark, sf_dir).entries)).drop("level")


def sst_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What opening each table file tells."""
    return sst.read_metadata(sst.table_images(Log.of(spark, sf_dir).entries, level=1))


def sst_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every GET looked up in the table file of the segment flushed before it: filter, index, short scan."""
    log = Log.of(spark, sf_dir)
    return sst.lookups(sst.table_images(log.entries), log.probes)


def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GET of every customer's key from a store of segment files."""
    store = SegmentStore(spark, scratch_path(spark, "store"))
    store.load(Log.of(spark, sf_dir).entries)
    return store.multi_get(_customers(spark, sf_dir))


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a stream of the events, read from its state store."""
    folder = stream_folder(spark)
    run_to_table(_event_stream(spark, sf_dir), folder)
    return stored_state(spark, folder)


def frame_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every command framed for the wire and read back."""
    commands = event_commands(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return commands.select("seq", unframe(frame(F.col("raw"))).cast("string").alias("raw"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, as the stream source takes a plain path for a folder and the table may be one file.
    return event_commands(spark.readStream.schema(known).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/event[s].parquet"))


def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot kept up by a stream of the events."""
    return run_to_table(_event_stream(spark, sf_dir), stream_folder(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        cmd_parse, cmd_reject_stats, kv_responses, kv_snapshot, kv_tombstones, kv_live_count, kv_get, kv_multi_get, kv_exists, kv_missing, kv_range_scan, mem_bytes, kv_segments,
        memtable_snapshot, sst_entries, kv_responses_observed, kv_snapshot_observed, level_layout, compaction_merge, read_path_trace, sst_layout, sst_sparse_index, sst_metadata,
        sparse_seek, lookup_cost, bloom_params, bloom_no_false_negative, wal_encode, wal_roundtrip, wal_recover, frame_roundtrip, stream_equals_batch,
        memtable_size, table_count, wal_recover_bytes, wal_files_recover, sst_roundtrip, sst_open, sst_lookup, store_get, stream_state,
    )
    return {f.__name__: f for f in own}


# DuckDB SQL. Common tables, put before each query that uses them.
_LOG = """
log AS (
    SELECT event_id AS seq, CASE event_type
        WHEN 'click' THEN 'SET user' || user_id || '=' || event_id
        WHEN 'signup' THEN 'set user' || user_id || ' = ' || event_id
        WHEN 'view' THEN 'GET user' || user_id
        WHEN 'error' THEN 'DELETE user' || user_id
        WHEN 'purchase' THEN 'SET user' || user_id || '=' || props END AS raw
    FROM events),
stripped AS (SELECT seq, raw, replace(raw, ' ', '') AS s FROM log),
coded AS (
    SELECT *, CASE
        WHEN raw IS NULL OR regexp_matches(raw, '[^\\x20-\\x7E]') OR contains(raw, ':') OR s = '' THEN -1
        WHEN lower(s[1]) IN ('s', 'g') AND length(s) < 3 THEN -2
        WHEN lower(s[1:3]) = 'set' THEN CASE WHEN length(s) >= 6 THEN 0 ELSE -2 END
        WHEN lower(s[1:3]) = 'get' THEN CASE WHEN length(s) >= 4 THEN 0 ELSE -2 END
        WHEN lower(s[1:6]) = 'delete' THEN CASE WHEN length(s) >= 7 THEN 0 ELSE -2 END
        ELSE -1 END AS reject_code
    FROM stripped),
named AS (SELECT *, CASE WHEN reject_code <> 0 THEN NULL WHEN lower(s[1:3]) = 'set' THEN 'SET' WHEN lower(s[1:3]) = 'get' THEN 'GET' ELSE 'DELETE' END AS cmd FROM coded),
parsed AS (
    SELECT seq, raw, cmd, reject_code, reject_code = 0 AS valid,
        CASE WHEN cmd = 'DELETE' THEN substr(s, 7) WHEN cmd IS NOT NULL THEN split_part(substr(s, 4), '=', 1) END AS key,
        CASE WHEN cmd = 'DELETE' THEN '' WHEN cmd IS NOT NULL THEN CASE WHEN strpos(substr(s, 4), '=') > 0
            THEN replace(substr(substr(s, 4), strpos(substr(s, 4), '=') + 1), '=', '') ELSE '' END END AS value
    FROM named)
"""
_LAST = """, last AS (
    SELECT key, seq, value, cmd = 'DELETE' AS tombstone FROM parsed WHERE cmd IN ('SET', 'DELETE') QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
state AS (SELECT key, value FROM last WHERE NOT tombstone AND value <> '')
"""
_SEGMENTS = f""", counted AS (
    SELECT seq, row_number() OVER (ORDER BY seq) AS rn, cmd = 'SET' AS is_set,
        CASE cmd WHEN 'SET' THEN length(key) + length(value) + 64 WHEN 'DELETE' THEN length(key) + 64 ELSE 0 END AS delta
    FROM parsed WHERE valid),
numbered AS MATERIALIZED (
    SELECT seq, rn, (sum(delta) OVER (ORDER BY rn))::BIGINT AS total, min(CASE WHEN is_set THEN rn END) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_set
    FROM counted),
fold AS (
    SELECT -1::BIGINT AS seg, 0::BIGINT AS upto, 0::BIGINT AS base
    UNION ALL
    SELECT seg + 1, rn, total FROM (
        SELECT f.seg, n.rn, n.total, row_number() OVER (ORDER BY n.rn) AS nth
        FROM fold f JOIN numbered s ON s.rn = f.upto + 1 JOIN numbered n ON n.rn >= s.next_set AND n.total >= f.base + {FLUSH}) WHERE nth = 1),
placed AS (
    SELECT n.seq, f.seg + 1 AS segment_id, n.total - f.base AS mem_bytes FROM numbered n ASOF JOIN fold f ON n.rn > f.upto),
ops AS (SELECT p.*, q.segment_id, q.mem_bytes FROM parsed p JOIN placed q USING (seq)),
segs AS (
    SELECT segment_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_ops, max(mem_bytes) AS bytes,
        bool_or(cmd = 'SET') AND max(mem_bytes) >= {FLUSH} AS flushed
    FROM ops GROUP BY segment_id),
entries AS (
    SELECT segment_id, key, CASE WHEN cmd = 'SET' THEN value END AS value, cmd = 'DELETE' AS tombstone FROM (
        SELECT *, bool_or(cmd = 'SET') OVER (PARTITION BY segment_id, key) AS has_set, row_number() OVER (PARTITION BY segment_id, key ORDER BY seq DESC) AS back
        FROM ops WHERE cmd IN ('SET', 'DELETE')) WHERE has_set AND back = 1),
merged AS (SELECT key, segment_id, value, tombstone FROM entries QUALIFY row_number() OVER (PARTITION BY key ORDER BY segment_id DESC) = 1),
levels AS (
    SELECT segment_id, (segment_id + 1) % 4 = 0 AS compacts, (segment_id + 1) % 4 AS l0_files, (CASE WHEN segment_id + 1 >= 4 THEN 1 ELSE 0 END)::BIGINT AS l1_files,
        CASE WHEN segment_id + 1 <= (SELECT count(*) FROM segs WHERE flushed) // 4 * 4 THEN 1 ELSE 0 END AS level
    FROM segs WHERE flushed),
sizes AS (SELECT *, 5 + length(key) + CASE WHEN tombstone THEN 0 ELSE 4 + length(value) END AS entry_size FROM entries),
laid AS (
    SELECT segment_id, row_number() OVER w - 1 AS ordinal, key, entry_size, 12 + coalesce(sum(entry_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS entry_offset
    FROM sizes WINDOW w AS (PARTITION BY segment_id ORDER BY key)),
idx AS (SELECT segment_id, key, entry_offset FROM laid WHERE ordinal % 16 = 0),
blooms AS (
    SELECT *, least(20, greatest(1, floor(m * ln(2) / n + 0.5)))::INTEGER AS k FROM (
        SELECT segment_id, count(*) AS n, greatest(64, ceil(-count(*) * ln(0.01) / (ln(2) * ln(2))))::BIGINT AS m FROM entries GROUP BY segment_id)),
probes AS (SELECT seq AS probe_id, segment_id - 1 AS segment_id, key FROM ops WHERE cmd = 'GET' AND segment_id > 0)
"""
_RECORD = """CASE WHEN cmd = 'SET'
    THEN format('{:08X}', 9 + length(key) + length(value)) || '01' || format('{:08X}', length(key)) || hex(key) || format('{:08X}', length(value)) || hex(value)
    ELSE format('{:08X}', 5 + length(key)) || '03' || format('{:08X}', length(key)) || hex(key) END"""
_CUSTOMERS = "SELECT DISTINCT 'user' || c_custkey AS key FROM customer"


def oracle_sql() -> dict[str, str]:
    log = lambda q: f"WITH {_LOG} {q}"
    last = lambda q: f"WITH {_LOG} {_LAST} {q}"
    segs = lambda q: f"WITH RECURSIVE {_LOG} {_SEGMENTS} {q}"
    return {
        "cmd_parse": log("SELECT seq, cmd, key, value, valid, reject_code FROM parsed"),
        "cmd_reject_stats": log("SELECT reject_code, cmd, count(*) AS n FROM parsed GROUP BY ALL"),
        "kv_responses": log("""SELECT seq, CASE WHEN cmd IS NULL THEN 'ERROR: bad request' WHEN cmd <> 'GET' THEN 'OK' ELSE coalesce(nullif(found, ''), 'NOT_FOUND') END AS response FROM (
            SELECT *, last_value(CASE WHEN cmd <> 'GET' THEN value END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found FROM parsed)"""),
        "kv_snapshot": last("SELECT * FROM state"),
        "kv_tombstones": last("SELECT key, seq FROM last WHERE tombstone"),
        "kv_live_count": last("SELECT count(*) AS live_keys FROM last WHERE NOT tombstone"),
        "kv_get": last("SELECT key, CASE WHEN tombstone OR value = '' THEN 'NOT_FOUND' ELSE value END AS response FROM last WHERE key = 'user7'"),
        "kv_multi_get": last(f"SELECT c.key, coalesce(value, 'NOT_FOUND') AS response FROM ({_CUSTOMERS}) c LEFT JOIN state USING (key)"),
        "kv_exists": last(f"SELECT c.key FROM ({_CUSTOMERS}) c SEMI JOIN state USING (key)"),
        "kv_missing": last(f"SELECT c.key FROM ({_CUSTOMERS}) c ANTI JOIN state USING (key)"),
        "kv_range_scan": last("SELECT key, value FROM state WHERE key >= 'user1' AND key < 'user2'"),
        "mem_bytes": segs("SELECT seq, mem_bytes FROM placed"),
        "kv_segments": segs("SELECT * FROM segs"),
        "memtable_snapshot": segs("SELECT key, value, tombstone FROM entries WHERE segment_id IN (SELECT segment_id FROM segs WHERE NOT flushed)"),
        "sst_entries": segs("SELECT * FROM entries"),
        "kv_responses_observed": segs("""
            , per AS (SELECT key, segment_id, CASE WHEN bool_or(cmd = 'SET') THEN arg_max(value, seq) FILTER (cmd <> 'GET') END AS closing FROM ops GROUP BY key, segment_id),
            stored AS (SELECT key, segment_id, last_value(closing IGNORE NULLS) OVER (PARTITION BY key ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM per),
            seen AS (SELECT seq, cmd, key, segment_id,
                    count(*) FILTER (cmd = 'SET') OVER w AS open_sets, last_value(CASE WHEN cmd <> 'GET' THEN value END IGNORE NULLS) OVER w AS open_value
                FROM ops WINDOW w AS (PARTITION BY key, segment_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
            SELECT seq, CASE WHEN cmd <> 'GET' THEN 'OK' ELSE coalesce(nullif(CASE WHEN open_sets > 0 THEN open_value ELSE old END, ''), 'NOT_FOUND') END AS response
            FROM seen JOIN stored USING (key, segment_id) UNION ALL SELECT seq, 'ERROR: bad request' FROM parsed WHERE NOT valid"""),
        "kv_snapshot_observed": segs("SELECT key, value FROM merged WHERE NOT tombstone AND value <> ''"),
        "level_layout": segs("SELECT * FROM levels"),
        "compaction_merge": segs("SELECT * FROM merged"),
        "read_path_trace": segs("""SELECT g.key, CASE WHEN m.key IS NULL THEN 'none' ELSE coalesce('L' || l.level, 'memtable') END AS place, m.segment_id, coalesce(m.tombstone, false) AS tombstone
            FROM (SELECT DISTINCT key FROM parsed WHERE cmd = 'GET') g LEFT JOIN merged m USING (key) LEFT JOIN levels l ON l.segment_id = m.segment_id"""),
        "sst_layout": segs("SELECT * FROM laid"),
        "sst_sparse_index": segs("SELECT * FROM idx"),
        "sst_metadata": segs("""SELECT segment_id, entry_count, data_end, data_end + 5 + (m + 7) // 8 AS index_offset, (data_end + 5 + (m + 7) // 8 + 4 + index_bytes + 40)::BIGINT AS file_size, min_key, max_key FROM (
            SELECT segment_id, count(*) AS entry_count, (12 + sum(entry_size))::BIGINT AS data_end, sum(CASE WHEN ordinal % 16 = 0 THEN 12 + length(key) ELSE 0 END) AS index_bytes, min(key) AS min_key, max(key) AS max_key
            FROM laid GROUP BY segment_id) JOIN blooms USING (segment_id)"""),
        "sparse_seek": segs("SELECT p.probe_id, p.segment_id, p.key, i.entry_offset AS seek_offset FROM probes p ASOF LEFT JOIN idx i ON p.segment_id = i.segment_id AND p.key >= i.key"),
        "lookup_cost": segs("""SELECT p.probe_id, p.segment_id, p.key, coalesce(l.key = p.key, false) AS hit,
                coalesce(least(l.ordinal + CASE WHEN l.key = p.key THEN 0 ELSE 1 END, b.n - 1) - l.ordinal // 16 * 16 + 1, 0) AS entries_read
            FROM probes p ASOF LEFT JOIN laid l ON p.segment_id = l.segment_id AND p.key >= l.key LEFT JOIN blooms b ON b.segment_id = p.segment_id"""),
        "bloom_params": segs("SELECT segment_id, n, m, k, 5 + (m + 7) // 8 AS section_bytes FROM blooms"),
        "bloom_no_false_negative": segs("SELECT segment_id, n AS n_keys, 0::BIGINT AS denied FROM blooms"),
        "wal_encode": log(f"SELECT seq, {_RECORD} AS record FROM parsed WHERE cmd IN ('SET', 'DELETE')"),
        "wal_roundtrip": segs("SELECT segment_id AS log_id, row_number() OVER (PARTITION BY segment_id ORDER BY seq) - 1 AS ordinal, cmd, key, value FROM ops WHERE cmd <> 'GET'"),
        "wal_recover": last("SELECT * FROM state"),
        "frame_roundtrip": log("SELECT seq, raw FROM log"),
        "stream_equals_batch": last("SELECT * FROM state"),
        "memtable_size": segs("SELECT count(*) AS n, coalesce(sum(length(key) + coalesce(length(value), 0) + 64), 0)::BIGINT AS bytes FROM entries WHERE segment_id IN (SELECT segment_id FROM segs WHERE NOT flushed)"),
        "table_count": segs("SELECT l0_files::BIGINT AS l0_files, l1_files, (l0_files + l1_files)::BIGINT AS tables FROM levels ORDER BY segment_id DESC LIMIT 1"),
        "wal_recover_bytes": segs("SELECT segment_id AS log_id, sum(CASE WHEN cmd = 'SET' THEN length(key) + length(value) + 64 ELSE 0 END)::BIGINT AS bytes FROM ops WHERE cmd <> 'GET' GROUP BY segment_id"),
        "wal_files_recover": last("SELECT * FROM state"),
        "sst_roundtrip": segs("SELECT segment_id, key, value, tombstone FROM entries"),
        "sst_open": segs("""SELECT segment_id, 1::INTEGER AS level, count(*) AS entry_count, (12 + sum(entry_size))::BIGINT AS data_end, count(*) FILTER (ordinal % 16 = 0) AS index_keys, min(key) AS min_key, max(key) AS max_key
            FROM laid GROUP BY segment_id"""),
        "sst_lookup": segs("SELECT segment_id, key, value, tombstone FROM entries SEMI JOIN probes USING (segment_id, key)"),
        "store_get": segs(f"""SELECT c.key, CASE WHEN m.key IS NULL OR m.tombstone OR m.value = '' THEN 'NOT_FOUND' ELSE m.value END AS response
            FROM ({_CUSTOMERS}) c LEFT JOIN merged m USING (key)"""),
        "stream_state": last("SELECT key, seq, value, tombstone FROM last"),
    }

