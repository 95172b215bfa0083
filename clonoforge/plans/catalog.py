"""All queries of the core, by name."""

from __future__ import annotations

from clonoforge.plans import analysis, pipelines, problems, relational

_PARTS = (problems, relational, analysis, pipelines)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
FLAGSHIP = relational.agg_cellranger
