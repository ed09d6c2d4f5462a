"""The queries over the driver tables, by name, with their DuckDB SQL."""

from ctxloom.plans import contracts, documents, evaluation, graphs, ingestion, pipelines, relational, retrieval, streams, tables  # noqa: F401  they register themselves
from ctxloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
