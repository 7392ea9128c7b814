"""Exact dedup with counting quotient filters.

Each partition turns the 64-bit fingerprints of its texts into counting quotient
filters, one for each slice of the fingerprint space. A slice's filters from all
partitions are merged by their sorted remainders, which loses nothing, and only
fingerprints counted more than once go on to the comparison of the texts' bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, checkpoint, ensure_columns, row_ids, scratch_name, scratch_table, small_enough


class CountingQuotientFilter:
    """A set of w-bit fingerprints with counts, stored as quotients and remainders.

    The quotient (high ``q`` bits) says which run a fingerprint is in; ``occupied``
    has a bit for each quotient that has a run, ``runend`` a bit for each slot that
    ends one. A slot holds a remainder, the runs' remainders ascend; a remainder
    seen more than once is followed by a slot with its count (``counter`` bit).
    As quotient and remainder are the whole fingerprint, nothing is approximate.
    """

    def __init__(self, width: int, q: int, occupied: np.ndarray, runend: np.ndarray, counter: np.ndarray, slots: np.ndarray):
        self.width, self.q = width, q
        self.occupied, self.runend, self.counter, self.slots = occupied, runend, counter, slots

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, width: int) -> CountingQuotientFilter:
        """``prints``: ascending and distinct, below 2**width; ``counts``: one or more each."""
        q = min(width, max(1, math.ceil(math.log2(len(prints) + 1))))
        quotients = (prints >> np.uint64(width - q)).astype(np.int64)
        remainders = prints & np.uint64((1 << (width - q)) - 1)
        many = counts > 1
        place = np.arange(len(prints)) + np.concatenate(([0], np.cumsum(many)[:-1])).astype(np.int64)
        total = len(prints) + int(many.sum())
        slots = np.zeros(total, np.uint64)
        slots[place] = remainders
        slots[place[many] + 1] = counts[many].astype(np.uint64)
        counter = np.zeros(total, bool)
        counter[place[many] + 1] = True
        last = np.ones(len(prints), bool)
        last[:-1] = quotients[1:] != quotients[:-1]
        runend = np.zeros(total, bool)
        runend[(place + many)[last]] = True
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        return cls(width, q, occupied, runend, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, ascending, and their counts."""
        run_of_slot = np.concatenate(([0], np.cumsum(self.runend)[:-1])).astype(np.int64)
        quotient = np.flatnonzero(self.occupied)[run_of_slot].astype(np.uint64) if len(self.slots) else np.zeros(0, np.uint64)
        is_print = ~self.counter
        prints = (quotient[is_print] << np.uint64(self.width - self.q)) | self.slots[is_print]
        counts = np.ones(len(prints), np.int64)
        counts[(np.cumsum(is_print) - 1)[self.counter]] = self.slots[self.counter].astype(np.int64)
        return prints, counts

    def to_bytes(self) -> bytes:
        """A slot takes the bytes that its widest remainder or count needs."""
        each = max(1, math.ceil(int(self.slots.max(initial=0)).bit_length() / 8))
        head = np.array([self.width, self.q, len(self.slots), each], np.int64).tobytes()
        narrow = np.ascontiguousarray(self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :each])
        return head + b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.runend, self.counter)) + narrow.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        width, q, n, each = np.frombuffer(raw, np.int64, 4).tolist()
        at, bits = 32, []
        for size in (1 << q, n, n):
            length = (size + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, length, at), count=size).astype(bool))
            at += length
        slots = np.zeros((n, 8), np.uint8)
        slots[:, :each] = np.frombuffer(raw, np.uint8, n * each, at).reshape(n, each)
        return cls(width, q, *bits, slots.view("<u8").ravel().astype(np.uint64))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The filter of the multiset union: equal fingerprints meet in sorted order, counts add."""
        parts = [f.items() for f in filters]
        prints = np.concatenate([p for p, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        order = np.argsort(prints, kind="stable")  # merges the sorted runs
        prints, counts = prints[order], counts[order]
        first = np.ones(len(prints), bool)
        first[1:] = prints[1:] != prints[:-1]
        return cls.build(prints[first], np.add.reduceat(counts, np.flatnonzero(first)), filters[0].width)


def _build_filters(slice_bits: int):
    width = 64 - slice_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches if b.num_rows]
        if not parts:
            return
        prints, counts = np.unique(np.concatenate(parts), return_counts=True)
        cut = np.searchsorted(prints >> np.uint64(width), np.arange((1 << slice_bits) + 1, dtype=np.uint64)) if slice_bits else np.array([0, len(prints)])
        slices, blobs = [], []
        for k in range(1 << slice_bits):
            lo, hi = int(cut[k]), int(cut[k + 1])
            if hi > lo:
                own = prints[lo:hi] & np.uint64((1 << width) - 1) if slice_bits else prints[lo:hi]
                slices.append(k)
                blobs.append(CountingQuotientFilter.build(own, counts[lo:hi], width).to_bytes())
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "filter"])

    return build


def _merge_filters(slice_bits: int):
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(b) for b in group["filter"]])
        prints, counts = merged.items()
        many = counts > 1
        whole = prints[many] | (np.uint64(int(group["slice"].iloc[0])) << np.uint64(64 - slice_bits) if slice_bits else np.uint64(0))
        return pd.DataFrame({"fp": whole.view(np.int64), "n": counts[many]})

    return merge


#: Fingerprints of a slice, about; a merge holds one slice.
SLICE_ROWS = 1 << 19


def repeated_fingerprints(prints: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``fp``, ``n`` for each value of the one long column that occurs more than once.

    ``prints`` is materialised. The number of slices, a power of two, follows the rows, so a
    merge holds about ``slice_rows`` fingerprints however many there are; a value with a
    third of all rows is one counter in each partition's filter.
    """
    slice_bits = max(1, math.ceil(math.log2(max(1, prints.count()) / slice_rows)))
    filters = prints.mapInArrow(_build_filters(slice_bits), "slice int, filter binary")
    return filters.groupBy("slice").applyInPandas(_merge_filters(slice_bits), "fp long, n long")


def normalised(text: str):
    """The text without the white space of the contract; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACE_CLASS + "+", "")


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs``: ``doc_id, text, rid`` (unique). Narrow rows, and the groups of equal texts with more than one row."""
    norm, size = normalised("text"), F.length(F.coalesce(F.col("text"), F.lit("")))
    rows = checkpoint(
        docs.select("doc_id", "rid", norm.alias("norm"), size.alias("size")).select("doc_id", "rid", "size", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    )
    repeated = checkpoint(repeated_fingerprints(rows.select("fp")).select("fp"))
    repeated = small_enough(repeated, 16)
    # Byte verification: grouping by the text itself compares it byte by byte, and each
    # map task sends a text once however many copies it holds.
    bytes_equal = (
        docs.select(norm.alias("norm"))
        .select("norm", F.xxhash64("norm").alias("fp"))
        .join(repeated, "fp", "left_semi")
        .groupBy("fp", "norm")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "n")
        .groupBy("fp", "sha")
        .agg(F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    )
    rank = F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    winners = rows.join(repeated, "fp", "left_semi").groupBy("fp", "sha").agg(F.min(rank).alias("keep"))
    groups = winners.join(bytes_equal, ["fp", "sha"]).select(
        "fp", "sha", "keep", F.when(F.col("texts") > 1, F.raise_error(F.lit("different texts with one SHA-256"))).otherwise(F.col("group_size")).alias("group_size")
    )
    # Read back from a table, the groups have no partitioning of their own: both sides of a join with them are then
    # shuffled for it, and adaptive execution can split a hot group's rows among tasks (or broadcast few groups).
    return rows, scratch_table(groups, "exact-groups")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: which row of its group of equal texts stays.

    Reads ``doc_id`` and ``text`` (other columns are ignored). Texts are equal if they
    are identical without white space ([\\x20\\x09-\\x0D]), whole, however long; a null text
    counts as empty, and all empty texts form one group. The row with the most code points
    stays, then the one with the smallest ``doc_id`` (null last); of repeated rows with the
    same ``doc_id`` exactly one stays. An empty table gives an empty result.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``.
    """
    rows, groups = _groups(ensure_columns(docs, doc_id="long", text="string").withColumn("rid", F.monotonically_increasing_id()))
    out = rows.join(groups, ["fp", "sha"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep.rid") == F.col("rid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that exact dedup keeps.

    What goes is a narrow table of row ids: broadcast if it is small, else the one shuffle
    of the texts.
    """
    stable, marked = row_ids(docs)
    rid = marked.columns[-1]
    rows, groups = _groups(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(rid).alias("rid")))
    gone = scratch_name(marked, "gone")
    dropped = checkpoint(rows.join(groups, ["fp", "sha"]).where("rid <> keep.rid").select(F.col("rid").alias(gone)))
    return marked.join(small_enough(dropped, 64), F.col(rid) == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in stable.columns])
