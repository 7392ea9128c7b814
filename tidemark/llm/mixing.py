"""Mix sources to target weights by pivotal dependent rounding, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_PATTERN, checkpoint, ensure_columns, row_ids, scratch_name

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of the sources: ``source, source_size, n`` gain ``target``.

    ``share`` of all sizes is dealt by weight; a source stops at ``cap`` times its size and
    the excess is dealt among the others again until none is above. That is the level
    ``t`` with sum(least(cap * size, t * weight)) = share * total, found with running sums
    over the sources in the order in which they reach their caps. The table has a row for
    each source, so these windows see no documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    fills = Window.orderBy("fill", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = (
        sizes.withColumn("weight", w)
        .withColumn("limit", F.col("source_size") * F.lit(cap))
        .withColumn("fill", F.col("limit") / F.col("weight"))
        .withColumn("due", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.sum("weight").over(fills) + F.col("weight"))
        .withColumn("filled", F.sum("limit").over(fills) - F.col("limit"))
    )
    # The level, were this source the first that does not fill up. With too few at their caps, or too many, it comes out too low.
    t = t.withColumn("level", F.max((F.col("due") - F.col("filled")) / F.col("rest_weight")).over(everything))
    target = F.least(F.col("limit"), F.col("level") * F.col("weight"))
    return t.select("source", "source_size", "n", target.alias("target"))


def _uniform(a: Column, b: Column, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), a["h"], b["h"], a["part"], b["part"]), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def _settle(pair: Column) -> Column:
    """Move copies between two documents until one is whole; words and expectations are kept."""
    a, b = pair["a"], pair["b"]
    up_a, down_b = (F.lit(1.0) - a["part"]) * a["size"], b["part"] * b["size"]
    down_a, up_b = a["part"] * a["size"], (F.lit(1.0) - b["part"]) * b["size"]
    to_a, to_b = pair["to_a"], pair["to_b"]

    def doc(x: Column, part: Column) -> Column:
        return F.struct(x["h"].alias("h"), x["doc"].alias("doc"), x["size"].alias("size"), part.cast("double").alias("part"))

    def out(done: Column, rest: Column) -> Column:
        return F.struct(done.alias("done"), rest.alias("rest"))

    gives = (
        F.when(pair["rises"] & (up_a <= down_b), out(doc(a, F.lit(1.0)), doc(b, F.greatest(F.lit(0.0), b["part"] - to_a / b["size"]))))
        .when(pair["rises"], out(doc(b, F.lit(0.0)), doc(a, F.least(F.lit(1.0), a["part"] + to_a / a["size"]))))
        .when(down_a <= up_b, out(doc(a, F.lit(0.0)), doc(b, F.least(F.lit(1.0), b["part"] + to_b / b["size"]))))
        .otherwise(out(doc(b, F.lit(1.0)), doc(a, F.greatest(F.lit(0.0), a["part"] - to_b / a["size"]))))
    )
    return gives


def _level(docs: Column, seed: int) -> Column:
    """Pair neighbours: an array of (done, rest), for an even number of documents."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(docs) / 2).cast("int") - 1), lambda i: F.struct(F.get(docs, i * 2).alias("a"), F.get(docs, i * 2 + 1).alias("b")))

    def measured(p: Column) -> Column:
        a, b = p["a"], p["b"]
        to_a = F.least((F.lit(1.0) - a["part"]) * a["size"], b["part"] * b["size"])
        to_b = F.least(a["part"] * a["size"], (F.lit(1.0) - b["part"]) * b["size"])
        return F.struct(a.alias("a"), b.alias("b"), to_a.alias("to_a"), to_b.alias("to_b"))

    def thrown(p: Column) -> Column:
        both = p["to_a"] + p["to_b"]
        rises = F.when(both <= 0, F.lit(True)).otherwise(_uniform(p["a"], p["b"], seed) * both < p["to_b"])
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), p["to_a"].alias("to_a"), p["to_b"].alias("to_b"), rises.alias("rises"))

    return F.transform(F.transform(F.transform(pairs, measured), thrown), _settle)


def _tree(docs: Column, seed: int) -> Column:
    """Reduce an array of documents to one residual: a struct of ``rest`` and the ``done``."""

    def step(state: Column, _: Column) -> Column:
        n = F.size(state["rest"])
        settled = F.transform(F.array(F.lit(0)), lambda _: _level(state["rest"], seed))[0]

        def joined(x: Column) -> Column:
            odd = F.slice(state["rest"], F.when(n % 2 == 1, n).otherwise(1), F.when(n % 2 == 1, 1).otherwise(0))
            return F.struct(
                F.concat(F.transform(x, lambda y: y["rest"]), odd).alias("rest"),
                F.concat(state["done"], F.transform(x, lambda y: y["done"])).alias("done"),
            )

        return F.when(n < 2, state).otherwise(F.transform(F.array(settled), joined)[0])

    start = F.struct(docs.alias("rest"), F.slice(docs, 1, 0).alias("done"))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(docs).cast("double"))).cast("int")))
    return F.aggregate(rounds, start, step)


#: Repeated rows that one step of their numbering makes at a time.
REPEATS = 1 << 16


def numbered(classes: DataFrame) -> DataFrame:
    """A row for each of the ``m`` rows of a class, with ``nth`` from 0 to m - 1.

    Classes of one row go as they are; a class of many is first cut into ranges of
    ``REPEATS`` rows, which are dealt to the tasks.
    """
    single = classes.where("m = 1").withColumn("nth", F.lit(0).cast("long")).drop("m")
    ranges = classes.where("m > 1").withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / REPEATS))))
    ranges = ranges.repartition("h", "range")
    start = F.col("range") * REPEATS
    return single.unionByName(ranges.withColumn("nth", F.explode(F.sequence(start, F.least(start + REPEATS, F.col("m")) - 1))).drop("m", "range"))


def _rounded(docs: DataFrame, weights: tuple[float, ...], share: float, cap: float, seed: int, fan_in: int) -> DataFrame:
    """``doc`` (``doc_id, key, rid, nth``), ``source, size, source_size, target, copies`` for each row.

    ``docs``: ``doc_id, text, source, rid``. ``rid`` is that of a row's class, the least
    of rows that agree in everything read here.
    """
    sized = docs.select("doc_id", "source", "rid", F.xxhash64("text").alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    classes = checkpoint(sized.groupBy("source", "doc_id", "key", "size").agg(F.count(F.lit(1)).alias("m"), F.min("rid").alias("rid")))
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # A fraction within rounding error of 0 or 1 is a whole number of copies.
    plan = (
        source_targets(sizes, weights, share, cap)
        .withColumn("ratio", ratio)
        .withColumn("whole", F.floor(F.col("ratio") + 1e-9))
        .withColumn("part", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")))
        .withColumn("groups", F.ceil(F.col("n") / fan_in))
        .select(F.col("source").alias("s"), "source_size", "target", "whole", F.when(F.col("part") < 1e-9, 0.0).otherwise(F.col("part")).alias("part"), "groups", "n")
    )
    plan = checkpoint(plan)
    largest = plan.agg(F.max("n")).first()[0] or 0
    rows = numbered(classes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "key", "size")))
    rows = rows.select("source", "size", F.struct("doc_id", "key", "rid", "nth").alias("doc"), F.xxhash64("h", "nth").alias("h"))
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    settled = [placed.where((F.col("size") == 0) | (F.col("part") == 0)).select("source", "doc", "size", F.lit(0.0).alias("part"))]
    open_rows = placed.where((F.col("size") > 0) & (F.col("part") > 0)).select("source", "h", "doc", "size", "part", "groups")
    left, level = largest, 0
    while left > 0:
        level += 1
        group = F.pmod(F.xxhash64(F.lit(seed + level), "h"), F.col("groups").cast("long"))
        grouped = open_rows.groupBy("source", group.alias("g"), "groups").agg(F.array_sort(F.collect_list(F.struct("h", "doc", F.col("size").cast("long").alias("size"), "part"))).alias("docs"))
        tree = checkpoint(grouped.select("source", "groups", _tree(F.col("docs"), seed + level).alias("t")))
        settled.append(tree.select("source", F.explode("t.done").alias("d")).select("source", "d.doc", "d.size", "d.part"))
        open_rows = tree.select("source", "groups", F.explode("t.rest").alias("d")).select("source", "d.*", F.ceil(F.col("groups") / fan_in).alias("groups"))
        if left <= fan_in:
            break
        left = math.ceil(left / fan_in)
    last = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "h"), 11).cast("double") * F.lit(2.0**-53)
    settled.append(open_rows.select("source", "doc", "size", F.when(last < F.col("part"), 1.0).otherwise(0.0).alias("part")))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("part").cast("long")).cast("long")
    out = out.join(plan.select("s", "source_size", "target", "whole"), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 5, fan_in: int = 128) -> DataFrame:
    """How often each document is taken so that the sources come near their targets.

    Reads ``doc_id``, ``text``, ``source``; other columns are ignored. A document's size is
    its number of words (null text: 0). Each source has a ratio target / size; a document is
    taken floor(ratio) times and once more for its share of the fraction. The fractions are
    rounded by the pivotal method, weighted by words: a pair of documents exchanges copies
    at random, words and expectations kept, until one is whole; the other goes on. Pairs
    meet in a reduction tree: in groups of about ``fan_in``, then among the groups'
    residuals, round after round, so that each source ends with one residual document
    and misses its target by less than that document's size.

    Null and empty texts have size 0 and no words to take (``copies`` is the whole part).
    A null source is a source of its own, last in order; null doc_ids are ordinary rows;
    very long texts are counted whole; an empty table gives an empty result. Repeated rows
    (and ties in ``doc_id``, text and source) are counted before the shuffle and numbered, so
    that they spread over the groups like any others. The draws are hashes of ``doc_id``,
    text, that number and ``seed``: reruns agree, however the table is cut. The sources'
    targets are found in one task, with a narrow row for each source.

    Returns ``doc_id, key`` (xxhash64 of the text), ``source, size, source_size, target,
    copies, taken``.
    """
    read = ensure_columns(docs, doc_id="long", text="string", source="string").withColumn("rid", F.lit(None).cast("long"))
    out = _rounded(read, weights, share, cap, seed, fan_in)
    return out.select("doc.doc_id", "doc.key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 5, fan_in: int = 128) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it.

    Rows that agree in ``doc_id``, ``text`` and ``source`` count as one document, which the
    first of them stands for and which is taken as often as all of them together. Documents
    without words are never taken.
    """
    stable, marked = row_ids(docs)
    rid = marked.columns[-1]
    read = marked.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("source", "string"))], F.col(rid).alias("rid"))
    taken = _rounded(read, weights, share, cap, seed, fan_in).where("size > 0 AND copies > 0")
    chosen, times, copy = (scratch_name(marked, x) for x in ("chosen", "times", "copy"))
    taken = checkpoint(taken.groupBy(F.col("doc.rid").alias(chosen)).agg(F.sum("copies").alias(times)))
    # Most rows are taken, so this is a join of two large tables at any size.
    joined = marked.hint("shuffle_merge").join(taken, F.col(rid) == F.col(chosen))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[F.col(f"`{c}`") for c in stable.columns])
