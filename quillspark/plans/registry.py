"""All core queries by name."""

from __future__ import annotations

from . import orphans, profiles, records, retrieval, search, texts

MODULES = [retrieval, search, texts, profiles, records, orphans]
FLAGSHIP = "bm25_topk"


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
