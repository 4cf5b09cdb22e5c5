"""All queries outside the optional ``llm`` subpackage."""

from __future__ import annotations

from docloom.plans import records, retrieval, structure

_MODULES = (records, structure, retrieval)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
