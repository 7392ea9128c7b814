"""Binary formats: big-endian integers, frames, log records, sorted table files."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

SET, GET, DELETE = 1, 2, 3
CODES = {"SET": SET, "GET": GET, "DELETE": DELETE}
NAMES = {v: k for k, v in CODES.items()}


def u32(n: Column) -> Column:
    """An integer as four bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def read_u32(raw: Column, at: int = 1) -> Column:
    return F.conv(F.hex(F.substring(raw, at, 4)), 16, 10).cast("long")


def u64(n: Column) -> Column:
    """An integer as eight bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def read_u64(raw: Column, at: int = 1) -> Column:
    return F.conv(F.hex(F.substring(raw, at, 8)), 16, -10).cast("long")


def frame(payload: Column) -> Column:
    """A length-prefixed frame of the wire protocol."""
    return F.concat(u32(F.octet_length(payload)), payload.cast("binary"))


def unframe(raw: Column) -> Column:
    """The payload of one frame, null if its length does not fit."""
    return F.when((F.octet_length(raw) >= 4) & (read_u32(raw) + 4 == F.octet_length(raw)), F.substring(raw, 5, 2147483647))


def split_frames(raw: bytes) -> Iterator[bytes]:
    """The payloads of concatenated frames; a torn one at the end is left out."""
    at = 0
    while at + 4 <= len(raw):
        (n,) = struct.unpack_from(">I", raw, at)
        if at + 4 + n > len(raw):
            return
        yield raw[at + 4 : at + 4 + n]
        at += 4 + n


def wal_record(cmd: Column, key: Column, value: Column) -> Column:
    """A log record: total length, command, key with length and, for SET, value with length."""
    code = F.when(cmd == "SET", F.unhex(F.lit("01"))).when(cmd == "GET", F.unhex(F.lit("02"))).otherwise(F.unhex(F.lit("03")))
    key_part = F.concat(code, u32(F.octet_length(key)), key.cast("binary"))
    whole = F.when(cmd == "SET", F.concat(key_part, u32(F.octet_length(value)), value.cast("binary"))).otherwise(key_part)
    return F.concat(u32(F.octet_length(whole)), whole)


def decode_wal(raw: bytes, mode: str = "strict") -> Iterator[tuple[str, bytes, bytes]]:
    """(command, key, value) of a log's records, up to the first that is torn or inconsistent.

    ``strict`` drops a torn record; ``observed`` also gives a last record whose final field is
    cut short, shortened, as a reader does that checks the length fields alone.
    """
    at, n = 0, len(raw)
    while at + 9 <= n:
        total, code, key_length = struct.unpack_from(">IBI", raw, at)
        torn = at + 4 + total > n
        key = raw[at + 9 : at + 9 + key_length]
        if code == DELETE and total == 5 + key_length:
            if torn and mode == "strict":
                return
            yield "DELETE", key, b""
        elif code == SET and at + 13 + key_length <= n:
            (value_length,) = struct.unpack_from(">I", raw, at + 9 + key_length)
            if total != 9 + key_length + value_length or (torn and mode == "strict"):
                return
            start = at + 13 + key_length
            yield "SET", key, raw[start : start + value_length]
        else:
            return
        if torn:
            return
        at += 4 + total


def entry_bytes(key: Column, value: Column, tombstone: Column) -> Column:
    """Size of an entry in a sorted table file; a tombstone has no value part."""
    return (F.lit(5) + F.octet_length(key) + F.when(tombstone, 0).otherwise(4 + F.octet_length(value))).cast("long")


def encode_entry(key: bytes, value: bytes | None, tombstone: bool) -> bytes:
    head = struct.pack(">I", len(key)) + key + bytes([tombstone])
    return head if tombstone else head + struct.pack(">I", len(value or b"")) + (value or b"")


def decode_entries(data: bytes) -> Iterator[tuple[bytes, bytes | None, bool]]:
    """The entries of a data section, up to a truncation."""
    at = 0
    while at + 5 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if at + 5 + n > len(data):
            return
        key, tombstone = data[at + 4 : at + 4 + n], bool(data[at + 4 + n])
        at += 5 + n
        if tombstone:
            yield key, None, True
            continue
        if at + 4 > len(data):
            return
        (m,) = struct.unpack_from(">I", data, at)
        if at + 4 + m > len(data):
            return
        yield key, data[at + 4 : at + 4 + m], False
        at += 4 + m


def bloom_shape(n: int, p: float = 0.01) -> tuple[int, int]:
    """Bits and hash functions of a bloom filter for ``n`` keys."""
    m = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return m, min(20, max(1, math.floor(m * math.log(2) / n + 0.5)))


def bloom_columns(n: Column, p: float = 0.01) -> tuple[Column, Column]:
    """The same as expressions: (bits, hash functions)."""
    m = F.greatest(F.lit(64), F.ceil(-n * F.lit(math.log(p)) / F.lit(math.log(2) ** 2))).cast("long")
    k = F.least(F.lit(20), F.greatest(F.lit(1), F.floor(m * F.lit(math.log(2)) / n + 0.5))).cast("int")
    return m, k
