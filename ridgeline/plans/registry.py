"""Queries of the terrain engine over the given tables, each with its SQL.

Floating-point columns are rounded so that both sides can be compared; each query
reads its whole tables.
"""

from __future__ import annotations

from ridgeline.plans import relational, terrain

QUERIES = terrain.QUERIES | relational.QUERIES
ORACLES = terrain.ORACLES | relational.ORACLES
