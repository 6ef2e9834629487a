"""The registered queries and their reference SQL."""

from cloakframe.queries import nested_queries, store_queries, text_queries  # noqa: F401
from cloakframe.queries.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
