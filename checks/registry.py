"""All registered queries and their oracle SQL."""

from checks import (  # noqa: F401
    feed_queries,
    identity_queries,
    vector_queries,
    write_queries,
)
from checks.query import BUILDERS, ORACLE, QUERIES

__all__ = ["BUILDERS", "ORACLE", "QUERIES"]
