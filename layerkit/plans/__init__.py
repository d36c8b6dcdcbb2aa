"""Registered queries: each a Spark plan over the driver tables and its SQL twin."""

from layerkit.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "load_all"]


def load_all() -> None:
    """Import every module that registers queries."""
    from layerkit.plans import (  # noqa: F401
        corpus_queries,
        layer_queries,
        ordered_queries,
        profile_queries,
        quality_queries,
        scalar_queries,
        table_queries,
    )
