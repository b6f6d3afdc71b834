"""Collects the registered queries and, side by side, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL twin when SQL can express it."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def plain(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Decimals as doubles, flags as ints, dates as ISO text; doubles rounded when ``digits`` is given."""
    new = {}
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType, T.DoubleType)):
            c = c.cast("double")
            new[f.name] = c if digits is None else F.round(c, digits)
        elif isinstance(f.dataType, T.BooleanType):
            new[f.name] = c.cast("int")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            new[f.name] = c.cast("date").cast("string")
    return df.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
