"""All queries of this package's own operators, by name, and their SQL."""

from __future__ import annotations

from loomnote.plans import vault_queries  # noqa: F401  (adds its queries)
from loomnote.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
