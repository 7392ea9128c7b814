"""Flush segments and levels of a command log.

Where a segment ends depends on where the one before ended. Still a range of the log can be
summed up without knowing that: for every place at which its first flush can come, how
many flushes follow in the range and what the open segment then holds. Such summaries
compose, so ranges are summed up and placed in parallel.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.commands import written_bytes
from tidemark.sources.scratch import checkpoint

FLUSH_BYTES = 4 << 20
COMPACT_TRIGGER = 4
#: Commands of a range, about; and how many summaries one task composes.
RANGE_ROWS, FAN_IN = 1 << 20, 64

#: What an open segment is when a range begins: flushes so far, bytes, has a SET.
State = tuple[int, int, bool]


def fold_segments(delta: np.ndarray, is_set: np.ndarray, flush_bytes: int, state: State) -> tuple[np.ndarray, np.ndarray, State]:
    """Segment and running bytes of each command of a batch, from ``state`` = (segment, bytes, has a SET).

    The counter is reset to 0 by a flush, which comes after the first command at which it
    has reached the threshold and the segment has a SET. Each flush is found by a binary
    search in running sums, so the work is a few numpy calls for each segment.
    """
    n = len(delta)
    sums = np.cumsum(delta)
    sets = np.flatnonzero(is_set)
    segment, carried, has_set = state
    ids, running = np.empty(n, np.int64), np.empty(n, np.int64)
    at = 0
    while at < n:
        base = int(sums[at - 1]) if at else 0
        full = int(np.searchsorted(sums, base + flush_bytes - carried, side="left"))
        first_set = at if has_set else (int(sets[k]) if (k := int(np.searchsorted(sets, at))) < len(sets) else n)
        last = max(full, first_set, at)
        stop = min(n, last + 1)
        ids[at:stop] = segment
        running[at:stop] = carried + sums[at:stop] - base
        if last >= n:
            carried, has_set = int(running[n - 1]), has_set or first_set < n
        else:
            segment, carried, has_set = segment + 1, 0, False
        at = stop
    return ids, running, (segment, carried, has_set)


@dataclass
class Summary:
    """What a range does to any open segment that it meets.

    ``sums``: running bytes, ascending, at the places where a first flush can come for want
    of bytes; ``flushes, left, sets``: for each such place how many flushes the range then
    has in all, the bytes open at its end and whether a SET is among them. ``late`` is
    the same for a first flush at the range's first SET, which comes at ``set_at`` bytes.
    """

    total: int
    set_at: int  # -1: no SET in the range
    sums: np.ndarray
    flushes: np.ndarray
    left: np.ndarray
    sets: np.ndarray
    late: tuple[int, int, bool]

    def apply(self, flush_bytes: int, flushes: np.ndarray, carried: np.ndarray, has_set: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states after the range for states before it, all at once."""
        has_set = has_set.astype(bool)
        due = np.searchsorted(self.sums, flush_bytes - carried, side="left")
        full = due < len(self.sums)
        at = np.minimum(due, max(0, len(self.sums) - 1))
        if self.set_at < 0:
            never, waits = ~has_set | ~full, np.zeros(len(carried), bool)
        else:
            waits = ~has_set & (carried + self.set_at >= flush_bytes)  # the bytes are there before the first SET, or with it
            never = ~waits & ~full
        pick = lambda own, late: np.where(waits, late, own[at] if len(own) else 0)
        return (
            flushes + np.where(never, 0, pick(self.flushes, self.late[0])),
            np.where(never, carried + self.total, pick(self.left, self.late[1])),
            np.where(never, has_set | (self.set_at >= 0), pick(self.sets, self.late[2])).astype(bool),
        )

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, head=np.array([self.total, self.set_at, *self.late], np.int64), sums=self.sums, flushes=self.flushes, left=self.left, sets=self.sets)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Summary:
        x = np.load(io.BytesIO(raw))
        total, set_at, *late = x["head"].tolist()
        return cls(total, set_at, x["sums"], x["flushes"], x["left"], x["sets"], (late[0], late[1], bool(late[2])))


def summarise(delta: np.ndarray, is_set: np.ndarray, flush_bytes: int) -> Summary:
    """Sum up a range, its first flush not known: from every candidate the flushes are followed to the end."""
    n = len(delta)
    sums = np.cumsum(delta)
    set_rows = np.flatnonzero(is_set)
    total = int(sums[-1]) if n else 0
    first_set = int(set_rows[0]) if len(set_rows) else n
    # A flush for want of bytes comes where the sum grows, and not later than the threshold after the start.
    grows = np.flatnonzero((delta > 0) & (sums - delta < flush_bytes))
    starts = np.append(grows, first_set) if first_set < n else grows
    last, flushes = starts.copy(), np.ones(len(starts), np.int64)
    open_ = np.arange(len(starts))
    next_set = np.append(set_rows, n)
    while len(open_):
        at = last[open_]
        full = np.searchsorted(sums, sums[at] + flush_bytes, side="left")
        with_set = next_set[np.searchsorted(set_rows, at + 1)]
        following = np.maximum(full, with_set)
        goes_on = following < n
        open_ = open_[goes_on]
        last[open_] = following[goes_on]
        flushes[open_] += 1
    left = total - sums[last] if len(last) else np.zeros(0, np.int64)
    sets = next_set[np.searchsorted(set_rows, last + 1)] < n if len(last) else np.zeros(0, bool)
    k = len(grows)
    late = (int(flushes[k]), int(left[k]), bool(sets[k])) if first_set < n else (0, 0, False)
    return Summary(total, int(sums[first_set]) if first_set < n else -1, sums[grows], flushes[:k], left[:k], sets[:k], late)


def compose(parts: list[Summary], flush_bytes: int) -> Summary:
    """The summary of adjacent ranges taken as one."""
    sums, states, offset, set_at, late = [], [], 0, -1, (0, 0, False)
    for k, part in enumerate(parts):

        def onward(flushes, left, sets, after=k + 1):
            state = flushes, left, sets
            for later in parts[after:]:
                state = later.apply(flush_bytes, *state)
            return state

        if offset < flush_bytes:
            own = (part.sums + offset) - np.diff(part.sums, prepend=0) < flush_bytes
            sums.append(part.sums[own] + offset)
            states.append(onward(part.flushes[own], part.left[own], part.sets[own]))
        if set_at < 0 and part.set_at >= 0:
            set_at = offset + part.set_at
            late = tuple(x[0].item() for x in onward(*(np.array([x]) for x in part.late)))
        offset += part.total
    flushes, left, sets = (np.concatenate(x) for x in zip(*states, strict=True))
    return Summary(offset, set_at, np.concatenate(sums), flushes, left, sets, late)


def _entries(ranges: int, summaries: DataFrame, flush_bytes: int, fan_in: int) -> dict[int, State]:
    """The state at the start of each range: composed upwards in a tree, told downwards. A few numbers for each range reach the driver."""

    def composed(g: pd.DataFrame) -> pd.DataFrame:
        parts = [Summary.from_bytes(x) for x in g.sort_values("k")["summary"]]
        return pd.DataFrame({"k": [int(g["k"].min()) // fan_in], "summary": [compose(parts, flush_bytes).to_bytes()]})

    def teller(known: dict[int, State]):
        def told(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("k")
            state = tuple(np.array([x]) for x in known[int(g["k"].min()) // fan_in])
            out = []
            for k, raw in zip(g["k"], g["summary"], strict=True):
                out.append((k, *(x[0].item() for x in state)))
                state = Summary.from_bytes(raw).apply(flush_bytes, *state)
            return pd.DataFrame(out, columns=["k", "segment", "carried", "has_set"])

        return told

    levels = [summaries]
    count = ranges
    while count > 1:
        levels.append(checkpoint(levels[-1].groupBy(F.floor(F.col("k") / fan_in)).applyInPandas(composed, "k long, summary binary")))
        count = math.ceil(count / fan_in)
    known: dict[int, State] = {0: (0, 0, False)}
    for level in reversed(levels[:-1]):
        rows = level.groupBy(F.floor(F.col("k") / fan_in)).applyInPandas(teller(known), "k long, segment long, carried long, has_set boolean").collect()
        known = {r["k"]: (r["segment"], r["carried"], r["has_set"]) for r in rows}
    return known


def segments(parsed: DataFrame, flush_bytes: int = FLUSH_BYTES, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``seq, segment_id, mem_bytes`` of every valid command (bytes before a flush resets them).

    Three narrow columns are sorted into ranges of about ``range_rows`` commands. Each range
    is summed up, the summaries are composed in a tree of ``fan_in``, and then each range is
    folded from the state at its start; nothing goes through one task. The result is
    checkpointed, so a plan that uses it several times folds once.
    """
    narrow = parsed.where("valid").select("seq", written_bytes(F.col("cmd"), F.col("key"), F.col("value")).alias("delta"), (F.col("cmd") == "SET").alias("is_set"))
    ranges = max(1, math.ceil(narrow.count() / range_rows))
    log = checkpoint(narrow.repartitionByRange(ranges, "seq").sortWithinPartitions("seq"))

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(b["delta"].to_numpy(), b["is_set"].to_numpy(bool)) for b in batches]
        delta, is_set = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, bool))
        yield pd.DataFrame({"k": [TaskContext.get().partitionId()], "summary": [summarise(delta, is_set, flush_bytes).to_bytes()]})

    entries = {0: (0, 0, False)}
    if ranges > 1:  # one range begins where the log does
        ranges = log.rdd.getNumPartitions()
        entries = _entries(ranges, checkpoint(log.mapInPandas(sum_up, "k long, summary binary")), flush_bytes, fan_in)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = entries[TaskContext.get().partitionId()]
        for b in batches:
            ids, running, state = fold_segments(b["delta"].to_numpy(), b["is_set"].to_numpy(bool), flush_bytes, state)
            yield pd.DataFrame({"seq": b["seq"], "segment_id": ids, "mem_bytes": running})

    return checkpoint(log.mapInPandas(fold, "seq long, segment_id long, mem_bytes long"))


def segment_table(parsed: DataFrame, placed: DataFrame, flush_bytes: int = FLUSH_BYTES, final_flush: bool = True) -> DataFrame:
    """A row for each segment: its first and last seq, commands, bytes, and whether it is flushed.

    The last segment is still open unless it ended with a flush; ``final_flush`` (shutdown)
    flushes it too, if it has a SET.
    """
    ops = parsed.where("valid").select("seq", "cmd").join(placed, "seq")
    out = ops.groupBy("segment_id").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n_ops"), F.max("mem_bytes").alias("bytes"), F.max((F.col("cmd") == "SET").cast("int")).alias("sets")
    )
    done = (F.col("sets") == 1) & ((F.col("bytes") >= flush_bytes) | F.lit(final_flush))
    return out.select("segment_id", "first_seq", "last_seq", "n_ops", "bytes", done.alias("flushed"))


def level_layout(table: DataFrame, trigger: int = COMPACT_TRIGGER) -> DataFrame:
    """After each flush: was it a compaction, how many files each level has, and where the segment's data is in the end.

    From an empty store flush f (from 1) compacts if f is a multiple of the trigger. Segments
    are numbered without gaps and all but the last are flushed, so the number of flushes is
    the largest number among them and one; the join is with that one row.
    """
    flushed = checkpoint(table.where("flushed"))
    total = flushed.agg((F.max("segment_id") + 1).alias("total"))
    f = F.col("segment_id") + 1
    return flushed.crossJoin(F.broadcast(total)).select(
        "segment_id",
        (f % trigger == 0).alias("compacts"),
        (f % trigger).alias("l0_files"),
        F.when(f >= trigger, 1).otherwise(0).cast("long").alias("l1_files"),
        F.when(f <= F.floor(F.col("total") / trigger) * trigger, 1).otherwise(0).cast("int").alias("level"),
    )
