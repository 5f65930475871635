"""All queries of the engine with their comparison SQL."""

from __future__ import annotations

from . import archive, cases, checks, collection, ingest, shapes, signals, streams

MODULES = [archive, ingest, cases, checks, signals, streams, collection, shapes]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: s for m in MODULES for name, s in m.ORACLE_SQL.items()}
