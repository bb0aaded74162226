"""All queries by name, and their SQL."""

from __future__ import annotations

from . import layouts, learning, oracles, queries

QUERIES = {**queries.QUERIES, **learning.QUERIES, **layouts.QUERIES}
ORACLES = {**oracles.ORACLES, **learning.ORACLES, **layouts.ORACLES}
