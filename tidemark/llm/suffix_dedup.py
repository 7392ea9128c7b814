"""Passages that repeat across documents, by sparse suffix arrays.

Suffixes are kept only where a content-selected minimiser stands: every window of
``min_words`` words keeps the position of its smallest seed (a short word n-gram, by hash),
so equal windows keep suffixes at the same place in them. Suffixes that share a seed are
sorted, neighbours are compared for the words that they have in common, and the matches are
extended left by comparing what stands before the seed in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, ensure_columns, scratch_table

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bits of a minimiser's key that hold its place; the others are the seed's hash.
_PLACE_BITS = 30
#: A seed with more suffixes than this is compared window by window, by as many tasks as it takes.
GROUP_ROWS = 8192


class _WordHashes(dict):
    """Word to hash; forgets all when it has grown, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers, _inverses = (np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64)), dtype=np.uint64) for x in (_BASE, _INVERSE))
    return _powers[:n], _inverses[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordText:
    """The words of a text (runs of other than ASCII white space), and slices of them joined by one space."""

    def __init__(self, text: str) -> None:
        self.words = text.encode("utf-8", "surrogatepass").split()
        self.n = len(self.words)
        self._joined = b" ".join(self.words) + b" "
        self._at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, self.words), np.int64, self.n) + 1)))

    def cut(self, start: np.ndarray, end: np.ndarray) -> Iterator[bytes]:
        """The words of each range, a space after each."""
        return map(self._joined.__getitem__, map(slice, self._at[start].tolist(), self._at[end].tolist()))

    def grams(self, length: int) -> np.ndarray:
        """Rolling hashes of all word n-grams; they only choose and group, what is equal is told by the words."""
        hashes = np.fromiter(map(_words.__getitem__, self.words), np.uint64, self.n)
        powers, inverse = _power_tables(self.n + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers[: self.n], dtype=np.uint64)))
        m = self.n - length + 1
        return _mixed((sums[length:] - sums[:m]) * inverse[:m] + np.uint64(length))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each window, by running minima from both ends of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def digests(parts: Iterator[bytes]) -> np.ndarray:
    """128-bit hashes as two columns of longs; of 1e13 different texts two agree with a chance of about 1e-13."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8").reshape(-1, 2)


def suffix_runs(t: WordText, min_words: int, seed_words: int) -> tuple[np.ndarray | pa.Array, ...] | None:
    """The kept suffixes of a text: ``seed`` (hash), ``lead`` (words that its windows reach before it), ``count`` (windows), ``w1, w2`` (digest of all their words), ``firsts``.

    Suffixes that agree in all their windows' words (a text that repeats itself) are one, with
    the first window of each in ``firsts``.
    """
    if t.n < min_words:
        return None
    grams = t.grams(seed_words)
    place = np.uint64((1 << _PLACE_BITS) - 1)
    keys = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)  # of equal seeds the leftmost
    at = (sliding_min(keys, min_words - seed_words + 1) & place).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.concatenate((first, [len(at)])))
    whole = digests(t.cut(first, first + count + (min_words - 1)))
    order = np.lexsort((first, whole[:, 1], whole[:, 0]))
    whole, first, count = whole[order], first[order], count[order]
    start = np.flatnonzero(np.concatenate(([True], (whole[1:] != whole[:-1]).any(axis=1))))
    firsts = pa.ListArray.from_arrays(pa.array(np.append(start, len(first)), pa.int32()), pa.array(first))
    first, whole = first[start], whole[start]
    return grams[at[first]].view(np.int64), at[first] - first, count[start], whole[:, 0], whole[:, 1], firsts


def _common(ids: np.ndarray, same_seed: np.ndarray) -> np.ndarray:
    """Words that each row has in common with the one before, from the first on; -1 where a seed begins."""
    equal = np.logical_and.accumulate(ids[1:] == ids[:-1], axis=1).sum(axis=1)
    return np.concatenate(([-1], np.where(same_seed, equal, -1)))


def _word_ids(texts: list[list[bytes]], width: int, ids: dict[bytes, int]) -> np.ndarray:
    out = np.empty((len(texts), width), np.int32)
    out[::2], out[1::2] = -1, -2  # padding never equals a neighbour's
    for k, words in enumerate(texts):
        out[k, : len(words)] = [ids.setdefault(w, len(ids)) for w in words]
    return out


def matched_windows(seed: np.ndarray, before: list[bytes], after: list[bytes], reach: tuple[np.ndarray, np.ndarray], low: np.ndarray, high: np.ndarray, min_words: int, seed_words: int) -> np.ndarray:
    """Which windows of each suffix are in several documents: a row for each, a column for the window's words before the seed.

    The suffixes come sorted by seed and ``after`` (the seed and what follows). Neighbours'
    common words cut the order into classes for every length; the suffixes sorted by the words
    ``before``, nearest first, are cut likewise. A window of ``o`` words before and
    ``min_words - o`` after is equal in two suffixes just if both classes are. ``reach``: the
    least and the largest ``o`` of each suffix's windows; ``low, high``: the documents that it stands for.
    """
    n, most = len(seed), min_words - seed_words
    ids: dict[bytes, int] = {}
    right = _common(_word_ids([x.split() for x in after], min_words, ids), seed[1:] == seed[:-1])
    left_ids = _word_ids([x.split()[::-1] for x in before], most, ids)
    order = np.lexsort((*left_ids.T[::-1], seed))
    ordered = left_ids[order]
    ordered[ordered < 0] -= 2 * (np.arange(n) % 2)[:, None].repeat(most, 1)[ordered < 0]  # again unlike a neighbour's
    left = _common(ordered, seed[order][1:] == seed[order][:-1])
    found = np.zeros((n, most + 1), bool)
    left_class = np.empty(n, np.int64)
    for o in range(most + 1):
        rows = np.flatnonzero((reach[0] <= o) & (o <= reach[1]))
        if len(rows) < 2:
            continue
        left_class[order] = np.cumsum(left < o)
        key = np.cumsum(right < min_words - o)[rows] * (n + 1) + left_class[rows]
        by_key = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], np.diff(key[by_key]) != 0)))
        several = np.minimum.reduceat(low[rows][by_key], start) < np.maximum.reduceat(high[rows][by_key], start)
        found[rows[by_key], o] = np.repeat(several, np.diff(np.concatenate((start, [len(rows)]))))
    return found


def _starts(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins in the flattened values."""
    return lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()


def _joined(function, rows: int = 4096):
    """Join the many small batches that ``function`` gives into fewer."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in function(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield pa.concat_batches(held)
                held, n = [], 0
        if held:
            yield pa.concat_batches(held)

    return grouped


def repeated_passages(docs: DataFrame, min_words: int = 50, seed_words: int = 12, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Maximal spans of words that windows of ``min_words`` words cover which occur in another document too.

    Reads ``doc_id`` and ``text``, whole, however long; other columns are left out. Words are
    runs of other than ASCII white space. Returns ``doc_id, start_word, end_word, n_words``, a
    row for each span; documents without a repeated window have none. A null, empty or shorter
    text has no window, an empty table no span. Rows without ``doc_id`` are left out; rows with
    the same ``doc_id`` count as one document; each of its different texts has spans of its own. Repeats inside one document alone don't count.

    Suffixes whose windows have the same words throughout (by a 128-bit digest) are one class,
    matched at once if it is in several documents; copies of a passage, however many, are never
    paired with each other. Where a seed has several classes, suffixes of these are sorted by
    their words, compared and extended. A seed with more than ``group_rows`` of them is no
    task's work: its windows are grouped one by one, by 128-bit digests.
    """
    docs = ensure_columns(docs, doc_id="long", text="string").where("doc_id IS NOT NULL AND text IS NOT NULL")
    docs = docs.withColumn("key", F.xxhash64("text"))  # tells texts of one doc_id apart
    kept = ["seed", "lead", "count", "w1", "w2", "firsts"]

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(b.column(1)):
                if found := suffix_runs(WordText(text.as_py()), min_words, seed_words):
                    doc, key = (pa.array(np.full(len(found[0]), b.column(c)[k].as_py(), np.int64)) for c in (0, 2))
                    yield pa.RecordBatch.from_arrays([doc, key, *map(pa.array, found[:-1]), found[-1]], names=["doc", "key", *kept])

    runs = docs.select("doc_id", "text", "key").mapInArrow(_joined(runs_of), "doc long, key long, seed long, lead long, count long, w1 long, w2 long, firsts array<long>")
    runs = scratch_table(runs, "suffix-runs")
    shared = runs.groupBy("seed").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("seed")
    # Tables read back have no partitioning of their own: both sides of a join are shuffled for it, and a hot seed can be split.
    shared = scratch_table(shared, "suffix-seeds")
    near = scratch_table(runs.join(shared, "seed", "left_semi"), "suffix-neighbours")
    classes = near.groupBy("seed", "w1", "w2").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    classes = scratch_table(classes, "suffix-classes")
    mixed = classes.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed", F.lit(True).alias("mixed"))
    # What a seed's number of classes says is put to the classes first, so that only one join sees all suffixes.
    classes = scratch_table(classes.join(mixed, "seed", "left").where("low < high OR mixed"), "suffix-marked")
    marked = scratch_table(near.join(classes, ["seed", "w1", "w2"]).drop("w1", "w2"), "suffix-matched")
    at_once = marked.where("low < high").select("doc", "key", F.explode("firsts").alias("s"), "count")
    at_once = at_once.select("doc", "key", "s", (F.col("s") + F.col("count") + (min_words - 1)).alias("e"))
    # A class's first document stands for it; suffixes of one document alone are all extended.
    wanted = marked.where("mixed AND doc = low")
    hot = checkpoint(wanted.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select("seed"))
    any_hot = not hot.isEmpty()

    def with_texts(rows: DataFrame) -> DataFrame:
        own = rows.groupBy(F.col("doc").alias("doc_id"), "key").agg(F.collect_list(F.struct("seed", "lead", "count", "low", "high", "firsts")).alias("runs"))
        return docs.join(own, ["doc_id", "key"]).select("doc_id", "key", "text", "runs")

    def contexts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, key, text, runs in zip(*[b.column(c) for c in range(4)], strict=True):
                t = WordText(text.as_py())
                seed, lead, count, low, high, firsts = runs.values.flatten()
                first = firsts.flatten().to_numpy()[_starts(firsts)]
                at, end = first + lead.to_numpy(), first + count.to_numpy() + (min_words - 1)
                before, after = pa.array(t.cut(first, at), pa.binary()), pa.array(t.cut(at, end), pa.binary())
                whose = (pa.array(np.full(len(seed), x.as_py(), np.int64)) for x in (doc, key))
                yield pa.RecordBatch.from_arrays([seed, *whose, lead, count, low, high, before, after, firsts], names=columns)

    columns = ["seed", "doc", "key", "lead", "count", "low", "high", "before", "after", "firsts"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            seeds = b.column(0).to_numpy()
            cut = int(np.searchsorted(seeds, seeds[-1])) if seeds[0] != seeds[-1] else 0
            if held and seeds[0] != held[-1].column(0)[-1].as_py():
                yield from spans_of(held)
                held = []
            if cut:
                yield from spans_of([*held, b.slice(0, cut)])
                held = []
            held.append(b.slice(cut))
        if held:
            yield from spans_of(held)

    def spans_of(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        seed, doc, key, lead, count, low, high = (rows.column(k).to_numpy() for k in range(7))
        found = matched_windows(seed, rows.column(7).to_pylist(), rows.column(8).to_pylist(), (lead - count + 1, lead), low, high, min_words, seed_words)
        found &= (low == high)[:, None]
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, start = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        for k, a, z in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True):
            at = np.array(rows.column(9)[k].as_py()) + lead[k]
            own = [np.full(len(at), doc[k]), np.full(len(at), key[k]), at - z + 1, at - a + min_words]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in own], names=["doc", "key", "s", "e"])

    normal = wanted.join(hot, "seed", "left_anti") if any_hot else wanted
    texts = with_texts(normal).mapInArrow(_joined(contexts_of), "seed long, doc long, key long, lead long, count long, low long, high long, before binary, after binary, firsts array<long>")
    # The sparse suffix array: all suffixes of a seed in one task, in the order of their words.
    ordered = texts.repartition("seed").sortWithinPartitions("seed", "after")
    spans = at_once.unionByName(ordered.mapInArrow(_joined(compare), "doc long, key long, s long, e long"))

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, key, text, runs in zip(*[b.column(c) for c in range(4)], strict=True):
                t = WordText(text.as_py())
                _, _, count, low, high, firsts = runs.values.flatten()
                each = np.diff(firsts.offsets.to_numpy())
                first, count, low, high = firsts.flatten().to_numpy(), *(np.repeat(x.to_numpy(), each) for x in (count, low, high))
                s = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                h = digests(t.cut(s, s + min_words))
                own = [h[:, 0], h[:, 1], np.full(len(s), doc.as_py(), np.int64), np.full(len(s), key.as_py(), np.int64), s, np.repeat(low, count), np.repeat(high, count)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in own], names=["h1", "h2", "doc", "key", "s", "low", "high"])

    if any_hot:
        windows = with_texts(wanted.join(hot, "seed", "left_semi")).mapInArrow(windows_of, "h1 long, h2 long, doc long, key long, s long, low long, high long")
        windows = scratch_table(windows, "suffix-windows")
        again = windows.groupBy("h1", "h2").agg(F.min("low").alias("l"), F.max("high").alias("g")).where("l < g").select("h1", "h2")
        again = scratch_table(again, "suffix-repeats")
        extended = windows.where("low = high").join(again, ["h1", "h2"], "left_semi").select("doc", "key", "s", (F.col("s") + min_words).alias("e"))
        spans = spans.unionByName(extended)
    by_start = Window.partitionBy("doc", "key").orderBy("s", "e")
    reached = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce(F.col("s") > reached, F.lit(True)).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = spans.groupBy("doc", "key", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"))
    return out.select(F.col("doc").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
