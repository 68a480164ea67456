"""The list of queries: functions of session and folder, and the SQL that says the same."""

from __future__ import annotations

import re

from . import telemetry_view as view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, chunk: int = view.CHUNK):
    """Register a query; SQL that reads ``rec`` gets the record view with texts in chunks of ``chunk`` characters."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = view.sql(chunk) + sql if re.search(r"\brec\b", sql) else sql
        return f

    return add
