"""Queries over the benchmark tables: each Spark query next to the SQL that must give the same rows."""

from __future__ import annotations

from registry import blend, collaborative, content, data, listener, quality, roundtrips, taste

MODULES = [data, content, collaborative, blend, listener, quality, roundtrips, taste]


def all_queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def all_oracles() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(m.ORACLES)
    return out
