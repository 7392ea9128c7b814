"""A store of sorted Parquet segments with a manifest.

Segments are immutable. A flush adds one at level 0, a compaction merges all into one at
level 1. Readers find segments only through the newest manifest, which is written last, so
a crash leaves unreferenced files, never a half state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.commands import reply
from tidemark.operators.changelog import newest_entries
from tidemark.operators.segments import COMPACT_TRIGGER

_ENTRY = "segment_id long, key string, value string, tombstone boolean"
_MANIFEST = "version long, level int, segment_id long, entry_count long, min_key string, max_key string, path string"


class SegmentStore:
    def __init__(self, spark: SparkSession, root: str, trigger: int = COMPACT_TRIGGER) -> None:
        self.spark, self.root, self.trigger = spark, root.rstrip("/"), trigger
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and self._fs.exists(self._path(f"{folder}/{n}/_SUCCESS")))

    def manifest(self, version: int | None = None) -> DataFrame:
        """A row for each segment of the newest version (or of ``version``)."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/v{version or versions[-1]}")

    def discover(self) -> None:
        """Where there is no manifest, commit one of the segments found by listing; of those written in whole."""
        if self.versions():
            return
        found = []
        for level in (0, 1):
            for status in self._fs.globStatus(self._path(f"{self.root}/L{level}/segment_id=*")) or []:
                path = status.getPath()
                if self._fs.exists(self._path(f"{path}/_SUCCESS")):
                    found.append(self._described(level, int(path.getName().split("=")[1].split("-")[0]), path.toString()))
        if found:
            self._commit(sorted(found, key=lambda r: r[1]))

    def table_count(self) -> int:
        return self.manifest().count()

    def _commit(self, rows: list[tuple]) -> None:
        version = (self.versions() or [0])[-1] + 1
        df = self.spark.createDataFrame([(version, *r) for r in rows], _MANIFEST)
        df.coalesce(1).write.mode("error").parquet(f"{self.root}/manifests/v{version}")

    def _write(self, entries: DataFrame, level: int, segment_id: int) -> tuple:
        path = f"{self.root}/L{level}/segment_id={segment_id}-{uuid.uuid4().hex[:8]}"
        out = entries.select(F.lit(segment_id).cast("long").alias("segment_id"), "key", "value", "tombstone")
        out = out.repartitionByRange("key").sortWithinPartitions("key")
        # The bloom filter is written only for chunks without a whole dictionary; keys are unique here.
        out.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.enable.dictionary#key", "false").parquet(path)
        return self._described(level, segment_id, path)

    def _described(self, level: int, segment_id: int, path: str) -> tuple:
        seen = self.spark.read.schema(_ENTRY).parquet(path).agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
        return (level, segment_id, seen[0], seen[1], seen[2], path)

    def _rows(self) -> list[tuple]:
        return [(r["level"], r["segment_id"], r["entry_count"], r["min_key"], r["max_key"], r["path"]) for r in self.manifest().collect()]  # a row for each file

    def flush(self, entries: DataFrame) -> None:
        """Add a segment (``key, value, tombstone``) at level 0; compact when the trigger is reached."""
        rows = self._rows()
        rows.append(self._write(entries, 0, max((r[1] for r in rows), default=-1) + 1))
        self._commit(rows)
        if sum(r[0] == 0 for r in rows) >= self.trigger:
            self.compact()

    def load(self, entries: DataFrame) -> None:
        """Add many segments (``segment_id, key, value, tombstone``) at level 0 in one job, without compactions.

        A segment is bounded by the flush threshold and written by one task. Their ids must be above those here.
        """
        rows = self._rows()
        folder = f"{self.root}/L0/load-{uuid.uuid4().hex[:8]}"
        out = entries.select("segment_id", "key", "value", "tombstone", F.col("segment_id").alias("part"))
        out = out.repartition("segment_id").sortWithinPartitions("segment_id", "key")
        out.write.partitionBy("part").option("parquet.bloom.filter.enabled#key", "true").option("parquet.enable.dictionary#key", "false").parquet(folder)
        written = self.spark.read.option("recursiveFileLookup", "true").schema(_ENTRY).parquet(folder)
        seen = written.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("segment_id").collect()  # a row for each file
        self._commit(rows + [(0, r["segment_id"], r["n"], r["low"], r["high"], f"{folder}/part={r['segment_id']}") for r in seen])

    def compact(self, drop_tombstones: bool = False) -> None:
        """Merge all segments into one at level 1; a full merge may drop tombstones."""
        rows = self._rows()
        if not rows:
            return
        merged = newest_entries(self.entries())
        if drop_tombstones:
            merged = merged.where(~F.col("tombstone"))
        self._commit([self._write(merged, 1, max(r[1] for r in rows))])
        self.vacuum()

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` manifests, and the files that only those named: readers of a version kept go on."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        live = {r["path"] for v in kept for r in self.manifest(v).select("path").collect()}
        for v in old:
            for r in self.manifest(v).select("path").collect():
                if r["path"] not in live:
                    self._fs.delete(self._path(r["path"]), True)
            self._fs.delete(self._path(f"{self.root}/manifests/v{v}"), True)

    def entries(self, key: str | None = None) -> DataFrame:
        """Entries of all segments; with a key, of those whose range covers it, filtered at the scan."""
        rows = [r for r in self._rows() if key is None or (r[2] and r[3] <= key <= r[4])]
        if not rows:
            return self.spark.createDataFrame([], _ENTRY)
        df = self.spark.read.schema(_ENTRY).parquet(*[r[5] for r in rows])
        return df if key is None else df.where(F.col("key") == key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """``key, response`` for each different ``key``: files whose range holds none of them are not read."""
        wanted = keys.select("key").distinct()
        low, high = wanted.agg(F.min("key"), F.max("key")).first()
        paths = [r[5] for r in self._rows() if low is not None and r[2] and r[3] <= high and r[4] >= low]
        entries = self.spark.read.schema(_ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], _ENTRY)
        inside = entries.where(F.col("key").between(low, high)) if paths else entries
        found = newest_entries(inside.join(wanted, "key", "left_semi"))
        return wanted.join(found, "key", "left").select("key", reply(F.lit("GET"), F.when(~F.col("tombstone"), F.col("value"))).alias("response"))

    def get(self, key: str) -> str:
        """The reply to GET: newest segment with an entry wins, a tombstone hides older ones."""
        row = newest_entries(self.entries(key)).select(reply(F.lit("GET"), F.when(~F.col("tombstone"), F.col("value"))).alias("r")).first()
        return row["r"] if row else "NOT_FOUND"
