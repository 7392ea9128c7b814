"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import checkpoint, scratch_table

#: The white space that the text contracts name: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, row_bytes: int, limit_bytes: int = 8 << 20) -> DataFrame:
    """Mark a *materialised* side for broadcast only if its counted size allows that.

    Beyond the limit the frame is returned as it is and Spark shuffles the join.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit_bytes else df


def row_ids(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` as a table that reads alike each time, and the same with ``rid``, a row's place in it.

    ``rid`` is (hash of the file's path, row in the file). A plain Parquet scan is taken as it
    is; anything else is written to the shared folder first. Rows can then be chosen by narrow
    tables of ids, repeated rows one by one.
    """
    plan = df._jdf.queryExecution().analyzed()
    plain = plan.nodeName().startswith("LogicalRelation") or "Relation" in plan.nodeName()
    if not plain or not df.inputFiles() or not df.inputFiles()[0].endswith(".parquet"):
        df = scratch_table(df, "rows")
    name = scratch_name(df, "rid")
    place = F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    return df, df.withColumn(name, place)


def scratch_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has (compared without case)."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in taken:
        k += 1
        name = f"__{stem}{k}"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that a result is about to add (names compared without case)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def ensure_columns(df: DataFrame, **types: str) -> DataFrame:
    """Cast the columns that an operator reads; a missing one is an error, not a null."""
    missing = [c for c in types if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large and small stars.

    ``edges``: columns ``a``, ``b`` (long). Returns ``node``, ``component`` (the
    smallest node reachable) for every node that has an edge to another one. Each
    round is a few aggregations with map-side combining and joins that adaptive
    execution can split; lineage is cut every round; nothing goes to the driver.
    """
    star = checkpoint(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    while not _is_star(star):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = (
            both.join(lows, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        )
        large = checkpoint(large)
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        moved = large.join(lows, "u").where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        star = checkpoint(moved.unionByName(lows.select("u", F.col("low").alias("v"))).distinct())
    centres = star.select("v").distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        centres.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )


def _is_star(edges: DataFrame) -> bool:
    """Every node has one smaller neighbour at most, and that one has none."""
    twice = edges.groupBy("u").count().where("count > 1").select("u")
    chained = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return twice.unionByName(chained).isEmpty()
