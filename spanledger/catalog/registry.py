"""All registered queries and their SQL, gathered from the catalog modules."""

from __future__ import annotations

from . import delivery, ingest, metrics, sections, streams, usage

MODULES = [usage, metrics, sections, delivery, ingest, streams]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
