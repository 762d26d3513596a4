"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import apply_settings

from .data import CheckData
from .views import duckdb_ctes

START, END = "1995-01-01", "2001-12-31"
FIRST_MONTH, LAST_MONTH = "1995-01-01", "2001-12-01"
CUTOVER = "1998-07-22"


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[CheckData], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(self.build(CheckData(apply_settings(spark), sf_dir)))

    @property
    def oracle(self) -> str | None:
        return duckdb_ctes(self.sql) if self.sql else None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(build: Callable[[CheckData], DataFrame]):
        key = name or build.__name__
        QUERIES[key] = Query(key, build, sql)
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, at the very end."""

    def column(field: T.StructField):
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.col(field.name).cast("string").alias(field.name)
        return F.col(field.name)

    return df.select(*(column(f) for f in df.schema.fields))
