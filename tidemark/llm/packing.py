"""Pack documents into token sequences by cutting-stock column generation.

A document fills whole sequences as far as it goes; its remainder is an item. Items are
counted by length class, a linear program over patterns of classes is solved by column
generation (a knapsack by dynamic programming prices the columns), the patterns' counts
are rounded, and the documents, ranked within their class, are dealt to the patterns. Where
the patterns leave room, the emptiest sequences are dissolved and their documents cut to
fill the others.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ensure_columns, scratch_table

#: Items of a class have lengths that differ by less than this.
GRAIN = 8
#: Documents that a task ranks at a time, about.
RANK_ROWS = 1 << 13
#: Room in a sequence, in grains, from which it is filled with pieces; a smaller one would cut documents too fine.
LEAST_ROOM = 8
_encodings: dict[tuple[str, str], object] = {}
#: Bytes of ids that a task hands on at a time, about.
BATCH_BYTES = 4 << 20
#: White space, as the pattern of the byte level means it, in runs too long for a pattern that looks back.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def encoding(vocabulary: str, end_of_text: str = "<|endoftext|>"):
    """A byte-level BPE of ``tokenizers`` (JSON), read into the faster encoder of ``tiktoken``.

    Both give the same ids: the ranks are the order of the merges, the pattern is the byte
    level's own, and the special token's text is recognised in a text by both.
    """
    import json

    import tiktoken

    if (vocabulary, end_of_text) not in _encodings:
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        vocab = model["vocab"]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token != end_of_text}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        special = {end_of_text: vocab.get(end_of_text, len(ranks))}
        _encodings[vocabulary, end_of_text] = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encodings[vocabulary, end_of_text]


def encode(coder, text: str) -> np.ndarray:
    """The ids of a text. Long runs of white space are encoded apart, with the same ids.

    The pattern makes one word of a run up to its last character, which goes with what
    follows, or of a whole run at the end of the text; nothing reaches across a run's start.
    """
    parts, at = [], 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > at:
            parts.append(coder.encode_to_numpy(text[at : run.start()], allowed_special="all"))
        parts.append(np.array(coder._core_bpe.encode_single_piece(text[run.start() : end].encode()), np.uint32))
        at = end
    if at < len(text) or not parts:
        parts.append(coder.encode_to_numpy(text[at:], allowed_special="all"))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def best_pattern(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the items' counts of most worth within the capacity."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    sizes, gains = lengths[order], worth[order]
    for c in range(int(sizes[0]), capacity + 1):
        n = int(np.searchsorted(sizes, c, side="right"))
        options = value[c - sizes[:n]] + gains[:n]
        k = int(np.argmax(options))
        if options[k] > value[c - 1]:
            value[c], choice[c] = options[k], k
        else:
            value[c] = value[c - 1]
    counts, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if choice[c] < 0 or value[c] == value[c - 1]:
            c -= 1
        else:
            counts[order[choice[c]]] += 1
            c -= int(sizes[choice[c]])
    return float(value[capacity]), counts


def first_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """A feasible basis (a column for each class): largest class first, filled as full as can be.

    A pattern is used until a class runs out, and later ones are without that class, so
    the columns are triangular in the order in which the classes run out.
    """
    m, left = len(lengths), demand.astype(np.float64)
    columns, has = np.zeros((m, m)), left > 0
    while has.any():
        live = np.flatnonzero(has)
        top = live[np.argmax(lengths[live])]
        pattern = np.zeros(m)
        pattern[top] = 1
        room = capacity - int(lengths[top])
        if room >= lengths[live].min():
            _, counts = best_pattern(lengths[live], lengths[live].astype(np.float64), room)
            pattern[live] += counts
        used = np.flatnonzero(pattern)
        times = left[used] / pattern[used]
        out = used[int(np.argmin(times))]
        left[used] -= pattern[used] * times.min()
        left[out], has[out] = 0.0, False
        left[left < 1e-9] = 0.0
        columns[:, out] = pattern
        for k in np.flatnonzero(has & (left == 0.0)):  # ran out at the same time: a column that is not used
            columns[k, k], has[k] = capacity // lengths[k], False
    return columns


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss and Jordan with row pivots (small matrices; no threads of a linear algebra library)."""
    m = len(a)
    work = np.hstack([a.astype(np.float64), np.eye(m)])
    for k in range(m):
        p = k + int(np.argmax(np.abs(work[k:, k])))
        if p != k:
            work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        factors = work[:, k].copy()
        factors[k] = 0.0
        rows = np.flatnonzero(factors)
        work[rows] -= factors[rows, None] * work[k][None, :]
    return work[:, m:]


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, steps: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often the linear program uses them.

    A revised simplex over the patterns known so far; each step prices with the knapsack.
    With the 256 classes of the defaults 553 steps at most were seen until the optimum was
    proven; ``steps`` only guards against endless turns of equal cost, and the patterns then
    at hand are feasible too.
    """
    m = len(lengths)
    patterns = first_patterns(lengths, demand, capacity)  # columns of the basis
    cost = np.ones(m)
    inverse = _inverse(patterns)
    least = math.ceil(float(lengths @ demand) / capacity - 1e-9)
    for _ in range(steps):
        x, dual = inverse @ demand, cost @ inverse
        if float(cost @ x) <= least + 1e-6:
            break  # no waste at all
        if (k := int(np.argmin(dual))) >= 0 and dual[k] < -1e-9:
            column, price = np.zeros(m), 0.0
            column[k] = -1.0  # more than asked of a class
        else:
            value, counts = best_pattern(lengths, np.maximum(dual, 0.0), capacity)
            if value <= 1.0 + 1e-7:
                break
            column, price = counts.astype(np.float64), 1.0
        turn = inverse @ column
        able = turn > 1e-9
        if not able.any():
            break
        ratio = np.full(m, np.inf)
        ratio[able] = np.maximum(x[able], 0.0) / turn[able]
        out = int(np.argmin(ratio))
        patterns[:, out], cost[out] = column, price
        row = inverse[out] / turn[out]
        inverse -= np.outer(turn, row)
        inverse[out] = row
    x = inverse @ demand
    real = (cost > 0) & (x > 1e-9)
    return patterns[:, real].T.round().astype(np.int64), x[real]


def plan_patterns(classes: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (class: items) and how often each is used, which hold every item exactly once.

    ``classes``: items of each class length. The program's counts are rounded down; what is
    then left is a few items for each pattern however many documents there are, and goes
    into sequences largest first.
    """
    left = {c: n for c, n in classes.items() if n}
    plan: list[tuple[dict[int, int], int]] = []
    if not left:
        return plan
    lengths = np.array(sorted(left), np.int64)
    patterns, x = column_generation(lengths, np.array([left[int(c)] for c in lengths], np.float64), capacity)
    for pattern, times in sorted(zip(patterns.tolist(), np.floor(x + 1e-6).astype(int).tolist(), strict=True), key=lambda p: -p[1]):
        items = {int(c): a for c, a in zip(lengths, pattern, strict=True) if a}
        times = min([times, *(left[c] // a for c, a in items.items())])
        if times > 0:
            plan.append((items, times))
            for c, a in items.items():
                left[c] -= a * times
    while any(left.values()):  # first fit decreasing by classes: fill one sequence, use it as often as it fits
        items, room = {}, capacity
        for c in sorted((c for c, n in left.items() if n), reverse=True):
            if a := min(left[c], room // c):
                items[c], room = a, room - a * c
        times = min(left[c] // a for c, a in items.items())
        plan.append((items, times))
        for c, a in items.items():
            left[c] -= a * times
    return plan


def dissolve(plan: list[tuple[dict[int, int], int]], capacity: int, least_room: int = LEAST_ROOM) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Take sequences out of the plan, emptiest first, as long as what they hold fits into the rooms of the others.

    Returns what stays of the plan and how many items of each class are to fill it.
    """
    rooms = [capacity - sum(c * a for c, a in items.items()) for items, _ in plan]
    free = sum(room * times for room, (_, times) in zip(rooms, plan, strict=True) if room >= least_room)
    loose, fill, kept = 0, {}, []
    for k in sorted(range(len(plan)), key=lambda k: -rooms[k]):
        items, times = plan[k]
        # A sequence taken out brings its items and takes its room with it.
        out = min(times, max(0, (free - loose) // capacity)) if rooms[k] >= least_room else 0
        free -= out * rooms[k]
        loose += out * (capacity - rooms[k])
        for c, a in items.items():
            fill[c] = fill.get(c, 0) + a * out
        if times > out:
            kept.append((items, times - out))
    return kept, {c: n for c, n in fill.items() if n}


class Dealer:
    """Where the document with a given rank in its class goes: the pieces of its remainder, each with sequence and place in it.

    The last documents of a class may be the ones that fill rooms: laid end to end, class
    after class, they run through all rooms, and are cut where a room ends.
    """

    def __init__(self, classes: dict[int, int], capacity: int, grain: int) -> None:
        plan, fill = dissolve(plan_patterns(classes, capacity), capacity)
        self.grain, self.sequences = grain, 0
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        next_rank: dict[int, int] = {}
        rooms, at = [], 0
        for items, times in plan:
            place = 0
            for c, a in sorted(items.items(), reverse=True):
                rows.setdefault(c, []).append((next_rank.get(c, 0), a, self.sequences, place))
                next_rank[c] = next_rank.get(c, 0) + a * times
                place += a
            room = capacity - sum(c * a for c, a in items.items())
            if room >= LEAST_ROOM:
                rooms.append((at, room, self.sequences))
                at += room * times
            self.sequences += times
        self._rows = {c: np.array(r, np.int64) for c, r in rows.items()}
        self._rooms = np.array(rooms, np.int64).reshape(-1, 3)
        self._whole = {c: n - fill.get(c, 0) for c, n in classes.items()}
        self._laid, at = {}, 0
        for c in sorted(fill, reverse=True):
            self._laid[c] = at
            at += c * fill[c]

    def pieces(self, c: int, rank: int, length: int) -> list[tuple[int, int, int]]:
        """(length, sequence, place) of each piece of a remainder of ``length`` tokens."""
        if rank < self._whole[c]:
            table = self._rows[c]
            start, each, base, place = table[int(np.searchsorted(table[:, 0], rank, side="right")) - 1].tolist()
            return [(length, base + (rank - start) // each, place + (rank - start) % each)]
        out, at = [], self._laid[c] + c * (rank - self._whole[c])
        while length > 0:
            start, room, base = self._rooms[int(np.searchsorted(self._rooms[:, 0], at, side="right")) - 1].tolist()
            ahead = room - (at - start) % room
            out.append((min(length, ahead * self.grain), base + (at - start) // room, (1 << 20) + at))
            at, length = at + ahead, length - ahead * self.grain
        return out


def tokenise(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """``doc_id, ids`` (little-endian 16-bit, the end id last) and their number ``n``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        for b in batches:
            first, ids, n, size = 0, [], [], 0
            for k, t in enumerate(b.column(1)):
                own = encode(coder, t.as_py() or "")
                if len(own) and int(own.max()) >= 1 << 16:
                    raise ValueError("the vocabulary has ids of more than 16 bits")
                ids.append(own.astype("<u2").tobytes() + end_id.to_bytes(2, "little"))
                n.append(len(own) + 1)
                size += len(ids[-1])
                if size >= BATCH_BYTES or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(n)), pa.array(ids, pa.binary()), pa.array(n, pa.int64())], names=["doc_id", "ids", "n"])
                    first, ids, n, size = k + 1, [], [], 0

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, ids binary, n long")


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 1, grain: int = GRAIN, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens.

    Reads ``doc_id`` and ``text``; other columns are left out. A null or empty text is the end
    id alone; repeated rows and rows that share a ``doc_id`` are documents of their own; very
    long texts are encoded whole, as are long runs of one character; an empty table gives no
    piece. Returns a row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids`` (the piece's ids, little-endian 16-bit).

    The documents get a row number in the table of their ids, which is written once, so the
    order within a class is the same for every task that is run again, ties or not.

    Only the histogram of length classes (``capacity / grain`` numbers) reaches the driver.
    A document's rank in its class is its rank within a salt plus the class's count in the
    salts before, so a class with a third of all documents is ranked by many tasks.
    """
    vocabulary = vocabulary or default_vocabulary()
    tokens = tokenise(ensure_columns(docs, doc_id="long", text="string"), vocabulary, end_id)
    tokens = scratch_table(tokens.withColumn("uid", F.monotonically_increasing_id()), "tokens")
    total = tokens.count()
    salts = max(1, math.ceil(total / rank_rows))
    # Copies that stand together stay together, up to 16 of them, which compresses well.
    h = F.xxhash64(F.lit("pack"), "doc_id", "n", F.shiftright("uid", 4))
    rest = F.col("n") % capacity
    tokens = tokens.withColumns({"h": h, "salt": F.pmod(h, F.lit(salts)), "c": F.ceil(rest / grain).cast("int"), "full": F.floor(F.col("n") / capacity)})
    counts = tokens.groupBy("c", "salt").agg(F.count(F.lit(1)).alias("items"), F.sum("full").alias("fulls"))
    earlier = Window.partitionBy("c").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("c", "salt", F.coalesce(F.sum("items").over(earlier), F.lit(0)).alias("items_before"), F.coalesce(F.sum("fulls").over(earlier), F.lit(0)).alias("fulls_before"))
    histogram = {r["c"]: (r["items"], r["fulls"]) for r in counts.groupBy("c").agg(F.sum("items").alias("items"), F.sum("fulls").alias("fulls")).collect()}
    dealer = Dealer({c: n for c, (n, _) in histogram.items() if c}, capacity // grain, grain)
    full_base, at = {}, dealer.sequences
    for c in sorted(histogram):
        full_base[c] = at
        at += histogram[c][1]
    ranked = Window.partitionBy("c", "salt").orderBy("h", "uid")
    fulls = F.coalesce(F.sum("full").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        tokens.withColumns({"rank": F.row_number().over(ranked) - 1, "fulls": fulls})
        .join(before, ["c", "salt"])
        .select("doc_id", "ids", "n", "c", (F.col("rank") + F.col("items_before")).cast("long").alias("rank"), (F.col("fulls") + F.col("fulls_before")).cast("long").alias("first_full"))
    )

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place", "ids"]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, pa.binary() if k == 7 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, raw, n, c, rank, first_full in zip(*[b.column(k) for k in range(6)], strict=True):
                doc, raw, n, c, rank, first_full = (x.as_py() for x in (doc, raw, n, c, rank, first_full))
                parts = [(capacity, full_base[c] + first_full + k, 0) for k in range(n // capacity)]
                if n % capacity:
                    parts += dealer.pieces(c, rank, n % capacity)
                start = 0
                for length, sequence, place in parts:
                    own = raw[2 * start : 2 * (start + length)]
                    out.append((doc, start, length, zlib.crc32(np.frombuffer(own, "<u2").astype("<u4").tobytes()), n, sequence, place, own))
                    start += length
                    if len(out) * 2 * capacity >= BATCH_BYTES:
                        yield packed(out)
                        out = []
            if out:
                yield packed(out)

    pieces = placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long, ids binary")
    inside = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"), "ids")
