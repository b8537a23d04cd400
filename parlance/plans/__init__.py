"""Queries with their oracles."""

from parlance.plans import archive, lifecycle  # noqa: F401  (each registers its queries)
