from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def tidy(rows: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded (sums depend on order in the last digits), whole numbers as long."""
    columns = []
    for name, kind in rows.dtypes:
        if kind == "double":
            columns.append(F.round(F.col(name), digits).alias(name))
        elif kind in ("int", "smallint", "tinyint") or kind.startswith("decimal"):
            columns.append(F.col(name).cast("long").alias(name))
        else:
            columns.append(F.col(name))
    return rows.select(*columns)
