"""The registered queries: importing the modules registers them."""

from quarry.plans import queries, rendering, retrieval

QUERIES, ORACLE_SQL = queries.QUERIES, queries.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "queries", "rendering", "retrieval"]
