"""The queries of this subpackage."""

from __future__ import annotations

import importlib

#: Modules that each hold QUERIES (name to function of session and folder) and SQL (name to DuckDB text).
MODULES = ("quality_rules", "minhash", "pii", "url_filters", "token_ids", "lattice_lm", "mixing", "packing", "embedding_dups", "quality_classifier")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"beaconry.llm.{name}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
