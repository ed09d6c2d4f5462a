"""How queries are registered: a decorator that takes the SQL, and small literal tables for what the driver tables lack."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its DuckDB SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return str(v)


@dataclass(frozen=True)
class Literal:
    """A literal table: as a DataFrame, and as SQL for a WITH clause."""

    name: str
    columns: tuple[str, ...]
    rows: tuple

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows], list(self.columns))

    @property
    def sql(self) -> str:
        body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"{self.name}({', '.join(self.columns)}) AS (VALUES {body})"


def values(name: str, columns: tuple[str, ...], rows: list) -> Literal:
    return Literal(name, columns, tuple(rows))
