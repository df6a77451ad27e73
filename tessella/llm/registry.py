"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import ann, concurrency, langid, licenses, linededup, lm, mixing, packing, quality, sharding, simhash, spelling, substrings

MODULES = (simhash, langid, licenses, ann, sharding, packing, linededup, lm, mixing, quality, substrings, spelling, concurrency)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
