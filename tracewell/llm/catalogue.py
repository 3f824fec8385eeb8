"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from tracewell.llm import line_dedup, mixing, neighbours, packing, pii, preference, quality, simhash, substring, tokens

_MODULES = (quality, tokens, simhash, pii, substring, packing, mixing, line_dedup, preference, neighbours)


def queries() -> dict:
    """Each module's opN_ function by its name."""
    return {name: getattr(m, name) for m in _MODULES for name in vars(m) if name.startswith("op") and name[2:].split("_")[0].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "SQL", {}).items()}
