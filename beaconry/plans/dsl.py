"""The predicate language: text to a tree to one Catalyst column.

Values are integers, byte strings or nothing. Each operand compiles to a pair of columns, one per type, of which
at most one is set in a row; comparisons with nothing are false, integers and strings are unequal, and
truth is two-valued. As a filter, comparisons outside of negations stay bare, so that the scan gets them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import TAGS, TelemetryError
from ..functions.text import until_nul

MAX_DEPTH = 64
_TOKEN = re.compile(rb"""[ \t\n\r]*(?:(?P<num>-?[0-9]+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|"(?P<str>(?:[^"\\]|\\.)*)"|(?P<op>&&|\|\||==|!=|<=|>=|[<>!().])|(?P<end>\Z))""", re.S)

# The fields of each kind by their names in the language; integers, then strings.
INTEGERS = {
    "heartbeat": {"seq": "seq", "uptime": "uptime_s"},
    "geo": {"lat": "lat_e7", "lon": "lon_e7", "alt": "alt_mm"},
    "battery": {"pct": "pct", "temp": "temp_c_e1", "cycles": "cycles"},
    "net": {"iface": "iface_id", "rx_bytes": "rx_bytes", "tx_bytes": "tx_bytes", "rx_pkts": "rx_pkts", "tx_pkts": "tx_pkts"},
    "firmware": {"major": "major", "minor": "minor", "patch": "patch"},
    "sensor": {"id": "sensor_id", "count": "size(samples)"},
    "event": {"code": "code", "len": "length(payload)"},
    "log": {"severity": "severity", "len": "length(msg)"},
    "keyref": {"slot": "slot_id"},
    "diag": {"subsystem": "subsystem", "len": "length(blob)"},
}
STRINGS = {"log": {"msg": "msg"}, "keyref": {"label": "label"}}


@dataclass(frozen=True)
class Node:
    """op: int, str, name, !, &&, || or a comparison; args: values or nodes."""

    op: str
    args: tuple


def tokens(text: str) -> list[tuple[str, bytes]]:
    data, at, out = text.encode(), 0, []
    if b"\0" in data:
        data = data.split(b"\0", 1)[0]
    while True:
        m = _TOKEN.match(data, at)
        if not m:
            raise TelemetryError("BADQUERY", text)
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
        if m.lastgroup == "end":
            return out


class _Parser:
    def __init__(self, text: str):
        self.text, self.rest = text, tokens(text)[::-1]

    def fail(self):
        raise TelemetryError("BADQUERY", self.text)

    def peek(self, *ops: str) -> str | None:
        kind, value = self.rest[-1]
        return value.decode() if kind == "op" and value.decode() in ops else None

    def take(self, *ops: str) -> str | None:
        found = self.peek(*ops)
        if found:
            self.rest.pop()
        return found

    def chain(self, op: str, inner, depth: int) -> Node:
        left = inner(depth + 1)
        while self.take(op):
            left = Node(op, (left, inner(depth + 1)))
        return left

    def either(self, depth: int) -> Node:
        return self.chain("||", self.both, depth)

    def both(self, depth: int) -> Node:
        return self.chain("&&", self.compared, depth)

    def compared(self, depth: int) -> Node:
        left = self.primary(depth + 1)
        op = self.take("==", "!=", "<", "<=", ">", ">=")
        return Node(op, (left, self.primary(depth + 1))) if op else left

    def primary(self, depth: int) -> Node:
        if depth > MAX_DEPTH:
            self.fail()
        if self.take("!"):
            return Node("!", (self.primary(depth + 1),))
        if self.take("("):
            inner = self.either(depth + 1)
            return inner if self.take(")") else self.fail()
        kind, value = self.rest.pop()
        if kind == "num":
            n = int(value)
            return Node("int", (n,)) if abs(n) < 2**63 else self.fail()
        if kind == "str":
            if re.search(rb'\\[^"\\]', re.sub(rb'\\\\|\\"', b"", value)):
                self.fail()
            return Node("str", (re.sub(rb"\\(.)", rb"\1", value, flags=re.S),))
        if kind != "name":
            self.fail()
        if not self.take("."):
            return Node("name", (value.decode(),))
        kind, field = self.rest.pop()
        return Node("name", (value.decode(), field.decode())) if kind == "name" else self.fail()


def parse(text: str) -> Node:
    p = _Parser(text)
    out = p.either(0)
    return out if p.rest[-1][0] == "end" else p.fail()


# ---- to columns -----------------------------------------------------------------------------------

Pair = tuple[Column | None, Column | None]


def _field(kind: str, expression: str) -> Column:
    m = re.fullmatch(r"(\w+)\((\w+)\)", expression)
    if not m:
        return F.col(f"{kind}.{expression}").cast("long")
    inner = F.col(f"{kind}.{m[2]}")
    # size(NULL) is -1 in some modes; nothing must stay nothing
    return F.when(inner.isNotNull(), {"size": F.size, "length": F.length}[m[1]](inner)).cast("long")


def _config_value(key: str) -> Column:
    """The first pair's value with this key; keys and values end at a NUL."""
    pairs = F.col("config.pairs")
    same = F.filter(pairs, lambda p: until_nul(p["key"]) == F.lit(bytearray(key.encode())))
    return until_nul(F.get(same, F.lit(0))["value"])


def resolve(parts: tuple) -> Pair:
    if len(parts) == 2:
        kind = parts[0].lower()
        if kind == "config":
            return None, _config_value(parts[1])
        i, s = INTEGERS.get(kind, {}).get(parts[1]), STRINGS.get(kind, {}).get(parts[1])
        return (_field(kind, i) if i else None), (F.col(f"{kind}.{s}") if s else None)
    name = parts[0]
    if name == "type":
        return F.col("tag").cast("long"), None
    if name.upper() in TAGS:
        return F.lit(TAGS[name.upper()]).cast("long"), None
    numbers = [_field(k, f[name]) for k, f in INTEGERS.items() if name in f]
    strings = [F.col(f"{k}.{f[name]}") for k, f in STRINGS.items() if name in f]
    return (F.coalesce(*numbers) if numbers else None), F.coalesce(*strings, _config_value(name))


def _value(node: Node) -> Pair:
    if node.op == "int":
        return F.lit(node.args[0]).cast("long"), None
    if node.op == "str":
        return None, F.lit(bytearray(node.args[0]))
    if node.op == "name":
        return resolve(node.args)
    return _truth(node, False).cast("long"), None


_OPS = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def _compare(op: str, left: Pair, right: Pair) -> list[Column]:
    """The ways in which the comparison can hold, each null or false otherwise."""
    ways = [getattr(x, _OPS[op])(y) for x, y in zip(left, right) if x is not None and y is not None]
    if op == "!=":  # an integer and a string
        ways += [x.isNotNull() & y.isNotNull() for x, y in ((left[0], right[1]), (left[1], right[0])) if x is not None and y is not None]
    return ways


def _any(ways: list[Column], bare: bool) -> Column:
    if not ways:
        return F.lit(False)
    out = ways[0] if bare else F.coalesce(ways[0], F.lit(False))
    for w in ways[1:]:
        out = out | (w if bare else F.coalesce(w, F.lit(False)))
    return out


def _truth(node: Node, bare: bool) -> Column:
    """bare: a null may stand for false, as in a filter outside of any negation."""
    if node.op == "!":
        return ~_truth(node.args[0], False)
    if node.op in ("&&", "||"):
        a, b = (_truth(x, bare) for x in node.args)
        return a & b if node.op == "&&" else a | b
    if node.op in _OPS:
        return _any(_compare(node.op, _value(node.args[0]), _value(node.args[1])), bare)
    number, text = _value(node)
    return _any(([number != 0] if number is not None else []) + ([F.length(text) > 0] if text is not None else []), bare)


def compile(text: str) -> Column:
    """A boolean column that is never null."""
    return _truth(parse(text), False)


def predicate(text: str) -> Column:
    """A column for ``filter``: true where the expression holds, false or null elsewhere."""
    return _truth(parse(text), True)


def select(records: DataFrame, text: str) -> DataFrame:
    """The records that match, untouched."""
    return records.filter(predicate(text))


def query(records: DataFrame, text: str) -> DataFrame:
    """The records that match once live key labels and sensitive payloads are blanked."""
    from ..operators.redact import redact_keystore

    return redact_keystore(records).filter(predicate(text))
