"""The query catalogue: each entry is a query over the driver's tables and, where SQL can say it, DuckDB SQL with the same rows."""

from __future__ import annotations

from tessera.plans import geometry_plans, mask_plans, pose_plans, relational_plans, text_plans

MODULES = (geometry_plans, relational_plans, text_plans, pose_plans, mask_plans)
CATALOGUE = {name: pair for module in MODULES for name, pair in module.QUERIES.items()}
QUERIES = {name: query for name, (query, _) in CATALOGUE.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
