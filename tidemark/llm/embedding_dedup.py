"""Near-duplicate embeddings by sorted projection passes.

Each pass orders the vectors of a label lexicographically by the concatenated signs of
random projections and compares every vector with a bounded window of its successors.
A run of keys with one prefix that a window can't hold is compared whole, in blocks, so
signs that are far from even (vectors with a common direction) lose no pair; a label
whose passes would compare as many pairs as there are is compared whole once.
The pairs verified in all passes are united; inside a component found so, all pairs are
then compared exactly, in blocks, so a window's bound loses no link of a dense group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, connected_components
from tidemark.llm.unions import Unions

#: Bits of a sort key.
KEY_BITS = 62


def prefix_bits(rows: int, window: int) -> int:
    """Signs that narrow ``rows`` vectors down to half a window, if each halves them."""
    return min(KEY_BITS, math.ceil(math.log2(max(1.0, 2.0 * rows / window))))


def passes_needed(rows: int, window: int, threshold: float, recall: float = 0.99) -> int:
    """Passes after which a pair exactly at the threshold has met with this probability.

    Such a pair agrees in a sign with probability 1 - angle / pi, wherever the other
    vectors are, and meets in a pass if it agrees in the signs of the prefix: the vectors
    that share them are in one window or are compared whole. More rows take more passes,
    not a longer window.
    """
    agree = 1.0 - math.acos(threshold) / math.pi
    meet = agree ** prefix_bits(rows, window)
    return max(3, math.ceil(math.log(1.0 - recall) / math.log(max(1e-12, 1.0 - meet)))) if meet < 1.0 else 3


def unit_rows(vectors: list) -> np.ndarray:
    """Rows of length 1 in double precision; large and tiny components are scaled first."""
    x = np.array([np.asarray(v, np.float64) for v in vectors], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _sort_keys(passes: int, seed: int):
    weights = np.int64(1) << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, rows in b.groupby("dim"):
                x = unit_rows(rows["embedding"].tolist())
                for p in range(passes):
                    signs = x @ np.random.default_rng([seed, p, int(dim)]).standard_normal((int(dim), KEY_BITS)) > 0
                    yield pd.DataFrame({"pass": np.int32(p), "label": rows["label"], "dim": rows["dim"], "k": signs @ weights, "id": rows["id"]})

    return keys


def _compare_windows(window: int, threshold: float):
    def compare(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("r", kind="stable")
        ids, own = g["id"].to_numpy(), ~g["tail"].to_numpy()
        run = g.groupby(["pass", "label", "dim"], sort=False).ngroup().to_numpy()
        unions = Unions(len(g))
        for _, at in pd.Series(np.arange(len(g))).groupby(run):
            rows = at.to_numpy()
            x = unit_rows(g["embedding"].iloc[rows].tolist())
            for d in range(1, min(window, len(rows) - 1) + 1):
                hit = own[rows[:-d]] & (np.einsum("ij,ij->i", x[:-d], x[d:]) >= threshold)
                unions.add(rows[:-d][hit], rows[d:][hit])
        a, b = unions.edges()
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    return compare


def _compare_runs(threshold: float):
    def compare(g: pd.DataFrame) -> pd.DataFrame:
        edges = []
        for (_, _, _, _, first, second), run in g.groupby(["pass", "label", "dim", "prefix", "x", "y"], sort=False):
            x, part, ids = unit_rows(run["embedding"].tolist()), run["part"].to_numpy(), run["id"].to_numpy()
            unions = Unions(len(run))
            for at in range(0, len(run), 256):  # a slab of the block's cosines at a time
                i, j = np.nonzero(x[at : at + 256] @ x[at:].T >= threshold)
                keep = (i < j) & ((part[at + i] != part[at + j]) if first != second else True)
                unions.add(at + i[keep], at + j[keep])
            a, b = unions.edges()
            edges.append(pd.DataFrame({"a": ids[a], "b": ids[b]}))
        return pd.concat(edges)

    return compare


def _count_links(threshold: float):
    def count(g: pd.DataFrame) -> pd.DataFrame:
        x, m, part = unit_rows(g["embedding"].tolist()), g["m"].to_numpy(np.float64), g["part"].to_numpy()
        within = g["x"].iloc[0] == g["y"].iloc[0]
        total = np.zeros(len(g), np.int64)
        for at in range(0, len(g), 1024):  # a slab of the block's cosines at a time
            near = x[at : at + 1024] @ x.T >= threshold
            near &= (np.arange(at, at + len(near))[:, None] != np.arange(len(g))[None, :]) if within else (part[at : at + 1024, None] != part[None, :])
            total[at : at + 1024] = (near @ m).astype(np.int64)
        return pd.DataFrame({"id": g["id"], "n": total})

    return count


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.93, window: int = 64, passes: int | None = None, seed: int = 2, chunk_rows: int = 4096, block_rows: int = 256, run_rows: int = 4096, block_limit: int = 8192
) -> DataFrame:
    """One row for each vector: ``vec_id, n_links, component_id, kept``.

    Reads ``vec_id``, ``embedding`` (array of float or double), ``label``; vectors are
    compared only where labels are equal and not null (and lengths are equal), by cosine in
    double precision. A vector that is null, empty, zero or has a null or non-finite
    component, one without a label and one without an id links with nothing: it is its own
    component with no links. Equal vectors of a label are joined first and compared once;
    repeated rows are vectors of their own, and so are different vectors with one vec_id,
    which that alone does not link; other columns are ignored. ``n_links``: other
    vectors linked directly; ``component_id``: the smallest vec_id reachable. An empty table
    gives an empty result. Exact counts inside a component of n different vectors take n * n
    cosines, whatever the method; each vector is sent to n / ``block_limit`` blocks (at least 8).
    """
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding").withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = checkpoint(rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("m")).withColumns({"dim": F.size("embedding"), "id": F.monotonically_increasing_id()}))
    labels = checkpoint(classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows")))
    most = labels.agg(F.max("rows")).first()[0] or 0
    bits = prefix_bits(most, window)
    if passes is None:
        passes = passes_needed(most, window, threshold)
    order = ["pass", "label", "dim", "k", "id"]
    keys = classes.select("id", "label", "dim", "embedding").mapInPandas(_sort_keys(passes, seed), "pass int, label string, dim int, k long, id long")
    ordered = checkpoint(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("p", F.shiftright("at", 33)).withColumn("pos", F.col("at").bitwiseAND((1 << 33) - 1))
    ends = ordered.groupBy("p").agg((F.max("pos") + 1).alias("n"))  # a row for each partition
    before = ends.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = ordered.join(before, "p").select("pass", "label", "dim", "id", (F.col("before") + F.col("pos")).alias("r"))
    chunk, inside = F.floor(F.col("r") / chunk_rows), F.col("r") % chunk_rows
    also = F.array(F.struct(chunk.alias("c"), F.lit(False).alias("tail")))
    before_too = F.concat(also, F.array(F.struct((chunk - 1).alias("c"), F.lit(True).alias("tail"))))
    placed = ranked.withColumn("to", F.explode(F.when((inside < window) & (chunk > 0), before_too).otherwise(also))).select("pass", "label", "dim", "id", "r", "to.c", "to.tail")
    found = placed.join(classes.select("id", "embedding"), "id").groupBy("c").applyInPandas(_compare_windows(window, threshold), "a long, b long")
    runs = ordered.select("pass", "label", "dim", F.shiftright("k", KEY_BITS - bits).alias("prefix"), "id")
    crowded = checkpoint(runs.groupBy("pass", "label", "dim", "prefix").count().where(F.col("count") > window + 1))
    compared = crowded.groupBy("label", "dim").agg(F.sum(F.col("count") * F.col("count")).alias("pairs"))
    every = F.coalesce("pairs", F.lit(0)) + F.col("rows") * (2 * passes * window) >= F.col("rows") * F.col("rows")
    entire = checkpoint(labels.where("rows > 1").join(compared, ["label", "dim"], "left").where(every).select("label", "dim", "rows"))
    in_runs = runs.join(crowded.join(entire, ["label", "dim"], "left_anti"), ["pass", "label", "dim", "prefix"])
    in_labels = classes.join(entire, ["label", "dim"]).select(F.lit(-1).alias("pass"), "label", "dim", F.lit(0).cast("long").alias("prefix"), "id", F.col("rows").alias("count"))
    crowd = in_runs.unionByName(in_labels).withColumn("g", F.ceil(F.col("count") / run_rows).cast("int"))
    crowd = crowd.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("g").cast("long")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    crowd = crowd.withColumns({"x": F.least("part", "o"), "y": F.greatest("part", "o")})
    # Short runs share a task's frame, each long run's block is one of its own.
    workers = math.ceil((crowded.where(F.col("count") <= 512).agg(F.sum("count")).first()[0] or 0) / run_rows) + 1
    own = F.xxhash64("pass", "label", "dim", "prefix", "x", "y")
    crowd = crowd.withColumn("w", F.when(F.col("count") <= 512, F.pmod(own, F.lit(workers).cast("long"))).otherwise(own))
    crowd = crowd.select("pass", "label", "dim", "prefix", "id", "part", "x", "y", "w").join(classes.select("id", "embedding"), "id")
    found = found.unionByName(crowd.groupBy("w").applyInPandas(_compare_runs(threshold), "a long, b long"))
    nodes = connected_components(found).join(classes.select(F.col("id").alias("node"), "low"), "node")
    # A component is cut into up to 8 parts of block_rows; a larger one into larger parts, so that a vector is sent to few blocks.
    n = F.count(F.lit(1))
    sizes = nodes.groupBy("component").agg(F.least(F.ceil(n / block_rows), F.greatest(F.lit(8), F.ceil(n / block_limit))).cast("int").alias("g"), F.min("low").alias("component_id"))
    components = checkpoint(nodes.drop("low").join(sizes, "component"))
    members = components.join(classes.select(F.col("id").alias("node"), "embedding", "m"), "node")
    members = members.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("g").cast("long")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    blocks = members.select("component", F.col("node").alias("id"), "embedding", "m", "part", F.least("part", "o").alias("x"), F.greatest("part", "o").alias("y"))
    counted = blocks.groupBy("component", "x", "y").applyInPandas(_count_links(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    known = (
        classes.join(components.select(F.col("node").alias("id"), "component_id"), "id", "left")
        .join(counted, "id", "left")
        .select("label", "embedding", F.coalesce("component_id", "low").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"))
    )
    linked = rows.where("usable").join(known, ["label", "embedding"]).select("vec_id", F.col("n").alias("n_links"), "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
