"""The command language as Column expressions: validation, parsing, replies.

All of them are built-in functions, so a scan of commands is one stage of generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed replies of the protocol.
OK, NOT_FOUND, BAD_REQUEST = "OK", "NOT_FOUND", "ERROR: bad request"
#: Fixed replies to a SET or DELETE whose log record, and to a SET whose entry, could not be written.
LOG_FAILED, SET_FAILED = "ERROR: failed to write WAL", "ERROR: failed to set key"
#: Bytes that the write accounting adds for each SET or DELETE.
ENTRY_OVERHEAD = 64


def without_spaces(raw: Column) -> Column:
    return F.replace(raw, F.lit(" "), F.lit(""))


# The verbs over the raw text, spaces allowed anywhere, with the characters that must follow. Patterns on the raw text keep
# ``cmd`` small when a filter on it is pushed down, where every reference to ``raw`` is replaced by its whole expression.
_BAD_CHARACTER = r"[^\x20-\x39\x3B-\x7E]"
_VERBS = {"SET": r"(?i)^ *s *e *t *[^ ] *[^ ] *[^ ]", "GET": r"(?i)^ *g *e *t *[^ ]", "DELETE": r"(?i)^ *d *e *l *e *t *e *[^ ]"}


def command(raw: Column) -> Column:
    """SET, GET or DELETE, null for a command that is rejected (also for null)."""
    out = F.when(raw.rlike(_BAD_CHARACTER), None)
    for verb, pattern in _VERBS.items():
        out = out.when(raw.rlike(pattern), verb)
    return out


def reject_code(raw: Column, cmd: Column) -> Column:
    """0 if valid, -1 syntax, -2 missing argument; null input is a syntax error."""
    s = without_spaces(raw)
    short = (F.lower(F.substring(s, 1, 1)).isin("s", "g") & (F.length(s) < 3)) | s.rlike(r"(?i)^(set|get|delete)")
    return F.when(cmd.isNotNull(), 0).when(~raw.rlike(_BAD_CHARACTER) & short, -2).otherwise(-1)


def parse(commands: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``cmd, key, value, valid, reject_code`` to a table of commands."""
    s, cmd = F.col("_s"), F.col("cmd")
    body = F.substring(s, 4, 2147483647)
    equals = F.instr(body, "=")
    key = F.when(cmd == "DELETE", F.substring(s, 7, 2147483647)).when(cmd.isNotNull(), F.substring_index(body, "=", 1))
    after = F.when(equals > 0, F.replace(F.substring(body, equals + 1, F.lit(2147483647)), F.lit("="), F.lit(""))).otherwise("")
    value = F.when(cmd == "DELETE", "").when(cmd.isNotNull(), after)
    named = commands.withColumns({"_s": without_spaces(F.col(raw)), "cmd": command(F.col(raw))})
    return named.withColumns({"reject_code": reject_code(F.col(raw), cmd), "key": key, "value": value, "valid": cmd.isNotNull()}).drop("_s")


def written_bytes(cmd: Column, key: Column, value: Column) -> Column:
    """What a command adds to the write counter: nothing for GET."""
    size = F.octet_length(key) + ENTRY_OVERHEAD
    return F.when(cmd == "SET", size + F.octet_length(value)).when(cmd == "DELETE", size).otherwise(0).cast("long")


def reply(cmd: Column, found: Column, logged: Column | None = None, stored: Column | None = None) -> Column:
    """The reply to a command; ``found``: the value that a GET sees (null or empty: none).

    ``logged`` and ``stored`` tell of a write whether its log record and its entry were written; not given: they were.
    """
    out = F.when(cmd.isNull(), BAD_REQUEST).when(cmd == "GET", F.coalesce(F.nullif(found, F.lit("")), F.lit(NOT_FOUND)))
    if logged is not None:
        out = out.when(~logged, LOG_FAILED)
    if stored is not None:
        out = out.when((cmd == "SET") & ~stored, SET_FAILED)
    return out.otherwise(OK)
