"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from folioflow.llm import chat, jaccard, langid, licenses, lines, mixing, neardup, packing, quality, tokens

MODULES = (tokens, jaccard, neardup, lines, licenses, quality, packing, chat, langid, mixing)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
