"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import checkpoint, scratch_name, without

#: Bits of a row's key in the second permutation.
KEY_BITS = 62


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good, by inversion, one way for all sizes.

    The probabilities are summed from ratios over the whole support, less the tails beyond
    12 deviations and 64: those hold under 1e-28 of the mass, far below the 2**-53 steps of
    the uniform number that is inverted. So memory and time grow with the deviation.
    """
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo == hi:
        return lo
    total = good + bad
    mean = draws * (good / total)
    spread = 12 * math.sqrt(mean * (bad / total) * ((total - draws) / total)) + 64
    a, b = max(lo, int(mean - spread)), min(hi, int(mean + spread) + 1)
    k = np.arange(a, b, dtype=np.float64)
    # log of P(k + 1) / P(k), summed from the window's start
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.cumsum(np.exp(logs - logs.max()))
    return min(b, a + int(np.searchsorted(weights, rng.random() * weights[-1], side="right")))


def split_capacities(rng: np.random.Generator, capacities: np.ndarray, draws: int) -> np.ndarray:
    """A multivariate hypergeometric draw: of each capacity, what the first ``draws`` rows take."""
    out, rest = np.zeros_like(capacities), int(capacities.sum())
    for k, c in enumerate(capacities.tolist()):
        rest -= c
        out[k] = hypergeometric(rng, c, rest, draws)
        draws -= int(out[k])
    return out


def matrix_row(partition: int, before: np.ndarray, capacities: np.ndarray, seed: int) -> np.ndarray:
    """Row ``partition`` of the communication matrix: how many of its rows go to each shard.

    ``before``: rows before each partition, and all rows at the end. The partitions are
    halved again and again, and each halving splits what its range must fill by a draw
    seeded by the range. So a task finds its own row alone with one draw for each shard and
    halving, all rows agree, and every column sums to the shard's exact size.
    """
    lo, hi, own = 0, len(before) - 1, capacities.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split_capacities(np.random.default_rng([seed, 0, lo, hi]), own, int(before[mid] - before[lo]))
        lo, hi, own = (lo, mid, left) if partition < mid else (mid, hi, own - left)
    return own


def near_equal(total: int, parts: int) -> np.ndarray:
    """Sizes that sum to ``total`` and differ by one at most, the larger ones first."""
    return np.full(parts, total // parts, np.int64) + (np.arange(parts) < total % parts)


def deal(partition: int, before: np.ndarray, capacities: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard and the key of each row of a partition: the first permutation and the seed of the second."""
    rng = np.random.default_rng([seed, 1, partition])
    shards = rng.permutation(np.repeat(np.arange(len(capacities), dtype=np.int32), matrix_row(partition, before, capacities, seed)))
    return shards, rng.integers(0, 1 << KEY_BITS, len(shards), dtype=np.int64)


def key_blocks(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Which of the shard's ranges of keys each key is in."""
    return (keys >> (KEY_BITS - 40)) * blocks >> 40


def shard(docs: DataFrame, shards: int, seed: int = 20, block_rows: int = 1 << 16, materialised: bool = False) -> DataFrame:
    """Shuffle all rows uniformly into ``shards`` shards whose row counts differ by one at most.

    Adds ``law`` ('rows'), ``shard`` (from 0) and ``slot`` (the place in the shard, gapless
    from 0) to the columns of ``docs``, replacing columns of these names. Rows count one by
    one: nulls, empty and very long texts, ties and repeated rows are ordinary rows, and equal
    texts are not held together (a uniform shuffle puts them anywhere). With fewer rows than
    shards the last shards are empty; an empty table gives an empty result.

    How many rows of each partition go to each shard is drawn exactly; the rows are dealt
    by a local permutation and exchanged, and permuted again by sorting random keys. A
    shard's keys are cut into even ranges of about ``block_rows`` rows, a task's work each;
    how many rows a range holds is counted by drawing the keys again, without the rows.
    The counts of the input's partitions are the only thing that reaches the driver.
    ``materialised``: the frame is a plain file scan, whose partitions come out alike each
    time; else it is checkpointed first. A task that meets another number of rows than was
    counted fails.
    """
    docs = without(docs, "law", "shard", "slot")
    if not materialised:
        docs = checkpoint(docs)
    counted = docs.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()  # a row for each partition
    sizes = np.zeros(max((r["p"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        sizes[r["p"]] = r["count"]
    before = np.concatenate(([0], np.cumsum(sizes)))
    total = int(before[-1])
    blocks = max(1, math.ceil(total / (shards * block_rows)))
    capacities = near_equal(total, shards)
    to, block, key, earlier, s, b = (scratch_name(docs, x) for x in ("shard", "block", "key", "earlier", "s", "b"))
    names = [*docs.columns, to, block, key]

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at = TaskContext.get().partitionId(), 0
        size = int(sizes[p]) if p < len(sizes) else 0
        goes_to, keys = deal(p, before, capacities, seed) if size else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        cut = key_blocks(keys, blocks).astype(np.int32)
        for b in batches:
            if at + b.num_rows > size:
                raise RuntimeError(f"partition {p} has more than the {size} rows counted; pass materialised=False")
            own = [pa.array(x[at : at + b.num_rows]) for x in (goes_to, cut, keys)]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=names)
        if at != size:
            raise RuntimeError(f"partition {p} has {at} rows, {size} were counted; pass materialised=False")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(shards * blocks, np.int64)
        for b in batches:
            for p in b["id"]:
                goes_to, keys = deal(int(p), before, capacities, seed)
                table += np.bincount(goes_to * np.int64(blocks) + key_blocks(keys, blocks), minlength=len(table))
        at = np.flatnonzero(table)
        yield pd.DataFrame({"s": (at // blocks).astype(np.int32), "b": (at % blocks).astype(np.int32), "n": table[at]})

    spark = docs.sparkSession
    tasks = max(1, math.ceil(math.sqrt(len(sizes))))  # a task's table has a number for each block, so tasks are few
    redrawn = spark.range(0, len(sizes), 1, tasks).mapInPandas(count, "s int, b int, n long").groupBy("s", "b").agg(F.sum("n").alias("n"))
    up_to = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = redrawn.select(F.col("s").alias(s), F.col("b").alias(b), F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias(earlier))

    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.IntegerType()), T.StructField(block, T.IntegerType()), T.StructField(key, T.LongType())])
    sent = docs.mapInArrow(permute, schema)
    place = F.row_number().over(Window.partitionBy(to, block).orderBy(key)).cast("long") - 1
    sorted_in_shard = sent.withColumn(key, place).join(starts, (F.col(to) == F.col(s)) & (F.col(block) == F.col(b)))
    return sorted_in_shard.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.lit("rows").alias("law"), F.col(to).alias("shard"), (F.col(key) + F.col(earlier)).cast("long").alias("slot")
    )
