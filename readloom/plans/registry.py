"""All registered queries on the driver's tables, and their SQL."""

from __future__ import annotations

from readloom.operators import blocks, catalog, chains, dominance, overlaps, quality_values, reads, seeds, sql_surface
from readloom.streaming import candidates

_ALL = reads.QUERIES | seeds.QUERIES | quality_values.QUERIES | chains.QUERIES | overlaps.QUERIES | catalog.QUERIES | dominance.QUERIES | candidates.QUERIES | sql_surface.QUERIES | blocks.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
