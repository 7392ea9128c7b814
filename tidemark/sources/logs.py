"""Sources of command logs: scripts, wire frames, write-ahead logs, the events table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.codec import decode_wal, split_frames
from tidemark.functions.commands import parse


def event_commands(events: DataFrame) -> DataFrame:
    """The canonical command log of the events table: ``seq, raw``."""
    key = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    number = F.col("event_id").cast("string")
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", F.concat(F.lit("SET "), key, F.lit("="), number))
        .when(kind == "signup", F.concat(F.lit("set "), key, F.lit(" = "), number))
        .when(kind == "view", F.concat(F.lit("GET "), key))
        .when(kind == "error", F.concat(F.lit("DELETE "), key))
        .when(kind == "purchase", F.concat(F.lit("SET "), key, F.lit("="), F.col("props")))
    )
    return events.select(F.col("event_id").alias("seq"), raw.alias("raw"))


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(event_commands(spark.read.parquet(f"{sf_dir}/events.parquet")))


#: A command's place in its session is the low part of ``seq``, the session's number the high one.
_SESSION_BITS = 32


def _ranked_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder (or one) with ``number``, the rank of their names from 0, compared as text."""
    files = spark.read.format("binaryFile").load(path)
    names = files.select("path").withColumn("name", F.element_at(F.split("path", "/"), -1))
    ranked = names.select("path", (F.row_number().over(Window.orderBy("name", "path")) - 1).cast("long").alias("number"))  # a row for each file
    return files.select("path", "content").join(ranked, "path")


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """Script files as ``session, seq, raw``: a line is a command, empty lines are skipped, ``exit`` ends the script.

    A file is one session, read by one task; sessions come one after the other in the order
    of the files' names. ``seq`` is the number of the line, beyond all of the sessions before.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for session, content in zip(b["number"], b["content"], strict=True):
                text = [line.rstrip("\r") for line in bytes(content).decode("latin-1").split("\n")]
                if "exit" in text:
                    text = text[: text.index("exit")]
                rows = [(session, (session << _SESSION_BITS) + i + 1, line) for i, line in enumerate(text) if line]
                yield pd.DataFrame(rows, columns=["session", "seq", "raw"])

    return _ranked_files(spark, path).select("number", "content").mapInPandas(lines, "session long, seq long, raw string")


def read_frames(df: DataFrame, column: str = "content", session: str | None = None) -> DataFrame:
    """Captured streams of frames as ``session, seq, raw``; each row of the input is a stream of its own.

    ``session`` names a column of numbers, different for each row, in whose order the streams
    follow each other; without it there may be one row only.
    """
    if session is None:
        if df.count() > 1:
            raise ValueError("several streams need a session column that orders them")
        df = df.withColumn("session", F.lit(0).cast("long"))
    streams = df.select(F.col(session or "session").cast("long").alias("session"), F.col(column).alias("content"))

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, content in zip(b["session"], b["content"], strict=True):
                rows = [(s, (s << _SESSION_BITS) + i + 1, p.decode("latin-1")) for i, p in enumerate(split_frames(bytes(content)))]
                yield pd.DataFrame(rows, columns=["session", "seq", "raw"])

    return streams.mapInPandas(frames, "session long, seq long, raw string")


def read_wal(images: DataFrame, mode: str = "strict", order: str = "log_id", column: str = "content") -> DataFrame:
    """Mutations of write-ahead log images: ``log_id, ordinal, cmd, key, value``.

    ``images``: ``log_id`` and the bytes; a log ends with its flush, so an image is bounded
    by the flush threshold and logs are decoded in parallel.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for log_id, content in zip(b[order], b[column], strict=True):
                rows = [(log_id, i, c, k.decode("latin-1"), v.decode("latin-1")) for i, (c, k, v) in enumerate(decode_wal(bytes(content), mode))]
                yield pd.DataFrame(rows, columns=["log_id", "ordinal", "cmd", "key", "value"])

    return images.select(order, column).mapInPandas(decode, "log_id long, ordinal long, cmd string, key string, value string")


def read_wal_files(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Write-ahead log files of a folder; ``log_id`` is the rank of their names, compared as text, from 1."""
    return read_wal(_ranked_files(spark, path).select((F.col("number") + 1).alias("log_id"), "content"), mode)


def write_images(images: DataFrame, folder: str, name: str = "name", column: str = "content") -> None:
    """Write each row's bytes as a file of ``folder``, which all executors share.

    A file is written under another name and then moved, so a task that runs again leaves no half of one.
    """
    import uuid

    from pyarrow import fs

    scheme, colon, rest = folder.partition(":")
    uri = f"file:///{(rest if colon else folder).lstrip('/')}" if not colon or scheme == "file" else folder.replace("s3a:", "s3:", 1)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, root = fs.FileSystem.from_uri(uri)
        at.create_dir(root)
        for b in batches:
            for n, content in zip(b[name], b[column], strict=True):
                part = f"{root}/.{n}-{uuid.uuid4().hex}"
                with at.open_output_stream(part) as f:
                    f.write(bytes(content))
                at.move(part, f"{root}/{n}")
            yield pd.DataFrame({"n": [len(b)]})

    images.select(name, column).mapInPandas(write, "n long").agg(F.sum("n")).collect()
