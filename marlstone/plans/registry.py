"""All registered queries of the reference's own operators with their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "marlstone.operators.metrics",
    "marlstone.operators.vectors",
    "marlstone.operators.chunking",
    "marlstone.operators.sheets",
    "marlstone.operators.retrieval",
    "marlstone.operators.rerank",
    "marlstone.operators.context",
    "marlstone.operators.graph",
    "marlstone.operators.rules",
    "marlstone.operators.corpus",
    "marlstone.operators.questions",
    "marlstone.operators.answers",
    "marlstone.operators.typing_rules",
    "marlstone.operators.search",
    "marlstone.operators.compression",
    "marlstone.operators.rollups",
    "marlstone.operators.staged",
    "marlstone.operators.traversal",
    "marlstone.operators.windows",
    "marlstone.functions.table_functions",
    "marlstone.functions.providers",
    "marlstone.functions.entities",
    "marlstone.sources.store",
    "marlstone.sources.rebuild",
    "marlstone.sources.queries",
    "marlstone.streaming.queries",
)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = import_module(_name)
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
