"""Registered queries: a DataFrame function, its output columns, and the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL_TYPES = {"long": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    columns: dict[str, str]
    sql: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, columns: str, sql: str | None = None, prelude: str = "", recursive: bool = False):
    """Register ``fn(spark, folder) -> DataFrame``; both sides are cast to ``columns`` ("type name, ...")."""
    typed = {c.split()[1]: c.split()[0] for c in columns.split(",")}

    def wrap(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def build(spark: SparkSession, folder: str) -> DataFrame:
            return fn(spark, folder).select(*[F.col(c).cast(t).alias(c) for c, t in typed.items()])

        text = None
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS {SQL_TYPES[t]}) AS {c}" for c, t in typed.items())
            ctes = (prelude.strip().rstrip(",") + ",\n" if prelude else "") + f"result AS (\n{sql.strip()}\n)"
            text = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\nSELECT {casts} FROM result"
        QUERIES[name] = Query(build, typed, text)
        return fn

    return wrap
