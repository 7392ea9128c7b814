"""SimHash near-dedup; pairs are discarded by pivot distance tables, survivors verified."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import checkpoint, connected_components, ensure_columns, row_ids, scratch_name, small_enough
from tidemark.llm.unions import Unions

#: The reference fingerprints (pivots) of the distance table: drawn once, alike everywhere.
PIVOTS = np.random.default_rng(3).integers(0, 1 << 64, 32, dtype=np.uint64)
#: A bucket with more fingerprints than this is compared part against part by several tasks.
PART_ROWS = 8192
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of the whole text's word shingles, repeats included; no word: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        cut = map(slice, starts[at : min(n, at + _CHUNK)].tolist(), last[at : at + _CHUNK].tolist())
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cut), repeat(42)), np.uint64, min(n - at, _CHUNK))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n)
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id``, ``rid`` and ``fp`` (the fingerprint as a signed long) of ``doc_id, rid, text``."""
    docs = docs.select("doc_id", "rid", "text")
    schema = T.StructType([*docs.schema.fields[:2], T.StructField("fp", T.LongType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(2)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints)], names=["doc_id", "rid", "fp"])

    return docs.mapInArrow(compute, schema)


def block_masks(rows: int, distance: int, per_bucket: int = 1024) -> list[int]:
    """Masks such that two fingerprints within ``distance`` agree under one of them.

    The bits are cut into ``distance + a`` blocks; at most ``distance`` blocks differ, so
    some ``a`` blocks agree. ``a`` is the least for which a bucket of random fingerprints
    holds ``per_bucket`` of them at most: more rows, longer keys, never a lost pair.
    """
    for a in range(1, 64 - distance):
        blocks = distance + a
        edges = [64 * k // blocks for k in range(blocks + 1)]
        single = [((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(blocks)]
        masks = [sum(c) for c in combinations(single, a)]
        if rows / 2.0 ** min(bin(m).count("1") for m in masks) <= per_bucket or len(masks) > 60:
            break
    return masks


def _near_edges(ids: np.ndarray, prints: np.ndarray, group: np.ndarray, part: np.ndarray, cross: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join, within each group, all rows linked by fingerprints within ``distance``.

    Rows are sorted by group. Pairs are made in pieces of bounded size; a pair that is
    already joined needs no test, one whose distances to a pivot differ by more than
    ``distance`` is discarded (triangle inequality), and the rest is verified.
    """
    n = len(ids)
    table = np.bitwise_count(prints[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    unions = Unions(n)
    label = unions.label
    ends = np.searchsorted(group, group, side="right")
    partners = ends - np.arange(n) - 1
    upto = np.concatenate(([0], np.cumsum(partners)))
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(upto, upto[row] + (1 << 20), side="right")) - 1)
        counts = partners[row:stop]
        total = int(counts.sum())
        if total:
            i = np.repeat(np.arange(row, stop), counts)
            j = i + 1 + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            keep = (label[i] != label[j]) & (~cross[i] | (part[i] != part[j]))
            i, j = i[keep], j[keep]
            for k in range(table.shape[1]):
                if not len(i):
                    break
                keep = np.abs(table[i, k] - table[j, k]) <= distance
                i, j = i[keep], j[keep]
            keep = np.bitwise_count(prints[i] ^ prints[j]) <= distance
            i, j = i[keep], j[keep]
            unions.add(i, j)
        row = stop
    a, b = unions.edges()
    return ids[a], ids[b]


def near_edges(prints: DataFrame, distance: int = 4, part_rows: int = PART_ROWS) -> DataFrame:
    """Edges ``a, b`` between ids that span the same components as all pairs within ``distance``.

    ``prints``: materialised ``fp`` (distinct) and ``id``. Fingerprints that agree on one of
    the block masks meet in a bucket; each bucket tests its pairs with the pivot table.
    A bucket of more than ``part_rows`` is cut into parts, and each pair of parts is a
    task's work of its own. A bucket gives one edge less than it has rows at most.
    """
    rows = prints.count()
    masks = block_masks(rows, distance)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    spread = prints.select("fp", "id", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("t", "mask"))
    keyed = spread.select("fp", "id", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("k"))
    large = checkpoint(keyed.groupBy("t", "k").count().where(F.col("count") > part_rows))
    whole = keyed
    parts = []
    if not large.isEmpty():
        cut = large.select("t", "k", F.ceil(F.col("count") / part_rows).cast("int").alias("g"))
        whole = keyed.join(cut, ["t", "k"], "left_anti")
        hot = keyed.join(cut, ["t", "k"]).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "fp"), F.col("g").cast("long")).cast("int"))
        other = hot.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        parts.append(other.select("fp", "id", "t", "k", "part", F.least("part", "o").alias("x"), F.greatest("part", "o").alias("y")))
    zero = F.lit(0)
    placed = whole.select("fp", "id", "t", "k", zero.alias("part"), zero.alias("x"), zero.alias("y"))
    for p in parts:
        placed = placed.unionByName(p)
    workers = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * len(masks) / 100_000))
    placed = placed.withColumn("w", F.pmod(F.xxhash64("t", "k", "x", "y"), F.lit(workers)).cast("int"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        keys = [g[c].to_numpy() for c in ("t", "k", "x", "y")]
        order = np.lexsort((g["fp"].to_numpy(), *keys))
        keys = [k[order] for k in keys]
        new = np.zeros(len(g), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        cross = keys[2] != keys[3]
        a, b = _near_edges(g["id"].to_numpy()[order], g["fp"].to_numpy()[order].view(np.uint64), np.cumsum(new), g["part"].to_numpy()[order], cross, distance)
        return pd.DataFrame({"a": a, "b": b})

    return placed.groupBy("w").applyInPandas(compare, "a long, b long")


def _linked(prints: DataFrame, distance: int, every: bool) -> DataFrame:
    """``fp``, ``low`` (its smallest ``doc_id``) and ``root``, which is equal in a component.

    A class of equal fingerprints is linked by its fingerprint, so no ids are mixed up;
    unless ``every``, only classes that have a ``doc_id`` link.
    """
    classes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    linking = classes if every else classes.where("low IS NOT NULL")
    components = connected_components(near_edges(linking.select("fp", F.col("fp").alias("id")), distance))
    return classes.join(components, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fp, component_id``.

    Reads ``doc_id`` and ``text``; other columns are ignored. Documents link if their
    fingerprints differ in ``distance`` bits at most; ``component_id`` is the smallest
    ``doc_id`` reachable. Null and empty texts, and such without words, have fingerprint 0
    and are linked like any other; fewer words than a shingle count as one shingle. Equal
    fingerprints are joined before any comparison, so copies cost one row. Rows without a
    ``doc_id`` link nothing themselves and get the component of their fingerprint. Rows
    that share a ``doc_id`` alone aren't linked.
    """
    prints = checkpoint(fingerprints(ensure_columns(docs, doc_id="long", text="string").withColumn("rid", F.lit(0)), shingle))
    classes = checkpoint(_linked(prints, distance, every=False))
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(classes.join(lows, "root"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one document of each component.

    That is the one with the smallest ``doc_id`` (of rows that share this id, one). Here
    rows without a ``doc_id`` link like any other; one of them stays where none has an id.
    What goes is a narrow table of row ids: broadcast if it is small, else the one shuffle
    of the texts.
    """
    stable, marked = row_ids(docs)
    rid = marked.columns[-1]
    prints = checkpoint(fingerprints(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(rid).alias("rid"), F.col("text").cast("string").alias("text"))))
    found = prints.join(_linked(prints, distance, every=True), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
    kept = checkpoint(found.groupBy("root").agg(first).select("first.rid"))
    gone = scratch_name(marked, "gone")
    dropped = checkpoint(prints.join(kept, "rid", "left_anti").select(F.col("rid").alias(gone)))
    return marked.join(small_enough(dropped, 64), F.col(rid) == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in stable.columns])
