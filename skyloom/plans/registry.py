"""Registered queries, each beside the SQL that states its result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    from skyloom.plans.tables import tables

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: plain(fn(tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def plain(df: DataFrame) -> DataFrame:
    """Render for comparison: dates and times as ISO text, lists as joined text, whole
    numbers as bigint, real numbers as double."""

    def rendered(field: T.StructField):
        c, t = F.col(field.name), field.dataType
        if isinstance(t, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(t, (T.TimestampNTZType, T.TimestampType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        if isinstance(t, T.ArrayType):
            return F.array_join(c.cast("array<string>"), ">")
        if isinstance(t, T.IntegralType):
            return c.cast("bigint")
        if isinstance(t, T.FractionalType):
            return c.cast("double")
        return c

    return df.select(*[rendered(f).alias(f.name) for f in df.schema.fields])
