"""All registered queries of the library proper."""

from __future__ import annotations

from affinix.plans import engagement, items, recommending

MODULES = (engagement, items, recommending)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.SQL.items()}
