"""A sequential model of the engine: one command after the other, with flushes and compactions."""

from __future__ import annotations


def parse(raw):
    """(command, key, value) or None, and the reject code."""
    if any(not 32 <= ord(c) <= 126 or c == ":" for c in raw):
        return None, -1
    s = raw.replace(" ", "")
    if not s:
        return None, -1
    low = s.lower()
    if low[0] in "sg" and len(s) < 3:
        return None, -2
    for verb, least in (("set", 6), ("get", 4), ("delete", 7)):
        if low.startswith(verb):
            if len(s) < least:
                return None, -2
            rest = s[len(verb) :]
            if verb == "delete":
                return ("DELETE", rest, ""), 0
            key, _, value = rest.partition("=")
            return (verb.upper(), key, value.replace("=", "")), 0
    return None, -1


class Store:
    def __init__(self, semantics="documented", flush_bytes=1 << 62, trigger=4):
        self.semantics, self.flush_bytes, self.trigger = semantics, flush_bytes, trigger
        self.memory, self.l0, self.l1, self.bytes = {}, [], [], 0

    def run(self, raw):
        command, _ = parse(raw)
        if command is None:
            return "ERROR: bad request"
        verb, key, value = command
        if verb == "GET":
            for table in [self.memory, *self.l0, *self.l1]:
                if key in table:
                    return table[key] or "NOT_FOUND"
            return "NOT_FOUND"
        if verb == "SET":
            self.memory[key] = value
            self.bytes += len(key) + len(value) + 64
        else:
            if self.semantics == "documented" or key in self.memory:
                self.memory[key] = None
            self.bytes += len(key) + 64
        if self.bytes >= self.flush_bytes and self.memory:
            self.flush()
        return "OK"

    def flush(self):
        self.l0.insert(0, dict(sorted(self.memory.items())))
        self.memory, self.bytes = {}, 0
        if len(self.l0) >= self.trigger:
            merged = {}
            for table in [*self.l1[::-1], *self.l0[::-1]]:
                merged.update(table)
            self.l0, self.l1 = [], [dict(sorted(merged.items()))]
