"""All registered queries and their SQL, gathered from the modules of queries."""

from __future__ import annotations

from palimpsest.queries import bases, history, identity, lineage, relations, text

MODULES = (relations, history, text, lineage, identity, bases)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items()}
