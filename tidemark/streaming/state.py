"""The key-value state kept up by Structured Streaming.

Late and reordered commands are no problem: the greatest ``seq`` wins, whenever it comes.
State is one row for each key ever seen, in RocksDB.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.commands import parse
from tidemark.operators.changelog import mutations
from tidemark.sources.scratch import delete, scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest(parsed: DataFrame) -> DataFrame:
    """The streaming aggregate: ``key`` and the struct ``m`` of its last mutation."""
    return mutations(parsed).groupBy("key").agg(F.max(F.struct("seq", "value", (F.col("cmd") == "DELETE").alias("tombstone"))).alias("m"))


_CHANGES = "key string, m struct<seq: bigint, value: string, tombstone: boolean>"


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_CHANGES).option("recursiveFileLookup", "true").parquet(f"{folder}/changes")


def run_to_table(commands: DataFrame, folder: str, merge_every: int = 16) -> DataFrame:
    """Drain a stream of ``seq, raw`` and return the snapshot ``key, value``.

    Each micro-batch appends the keys it changed under its batch id, replacing what a
    failed attempt of that batch left; the snapshot takes the greatest ``seq`` of a key.
    After every ``merge_every`` batches the changes so far are merged into one table and
    the older ones deleted, so what a snapshot reads is bounded by the keys, not the log.
    A crash between the two leaves changes twice, which the greatest ``seq`` doesn't mind.
    """
    spark = commands.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.select("key", "m").write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")
        if batch_id % merge_every == merge_every - 1:
            merge_changes(spark, folder)

    query = latest(parse(commands)).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = _changes(spark, folder).groupBy("key").agg(F.max("m").alias("m"))
    return last.where(~F.col("m.tombstone") & (F.col("m.value") != "")).select("key", "m.value")


def merge_changes(spark: SparkSession, folder: str) -> None:
    """One table in place of all change batches of a stream."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/changes")
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    old = [s.getPath().toString() for s in listed]
    _changes(spark, folder).groupBy("key").agg(F.max("m").alias("m")).write.parquet(f"{folder}/changes/merged-{uuid.uuid4().hex}")
    for done in old:
        delete(spark, done)


def stored_state(spark: SparkSession, folder: str) -> DataFrame:
    """The stream's state as its state store holds it after the last batch: ``key, seq, value, tombstone``. No change batch is read."""
    state = spark.read.format("statestore").load(f"{folder}/checkpoint")
    held = state.select("key.key", F.col("value").getField(state.schema["value"].dataType.names[0]).alias("m"))
    return held.select("key", "m.seq", "m.value", "m.tombstone")


def stream_folder(spark: SparkSession) -> str:
    """A new folder under the one that all executors share."""
    return scratch_path(spark, "stream")
