"""Queries over the given tables, each with the SQL it must agree with."""

from propensia.catalog.registry import ORACLES, QUERIES

from propensia.catalog import io_queries, learned_queries, model_queries, relational_queries, rule_queries  # noqa: E402,F401  isort:skip

__all__ = ["ORACLES", "QUERIES"]
