"""Warehouse tables by name, from parquet, the catalog or JDBC."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

# The warehouse tables the checks read.
SELLER_SALES = "ecommerce_export_seller_sales"
SELLER_TRAFFIC = "ecommerce_export_seller_traffic"
SKU_SALES = "ecommerce_export_sku_sales"
SKU_TRAFFIC = "ecommerce_export_sku_traffic"
ITEM = "ecommerce_item"
SKU = "ecommerce_sku"
SELLER = "ecommerce_seller"
TABLES = (SELLER_SALES, SELLER_TRAFFIC, SKU_SALES, SKU_TRAFFIC, ITEM, SKU, SELLER)

JDBC_FETCH_ROWS = 10_000
CONNECT_TIMEOUT_SECONDS = 20


class Warehouse:
    """Resolves a table name to a DataFrame on first use. One instance is one snapshot."""

    def __init__(self, resolve: Callable[[str], DataFrame]):
        self._resolve = resolve
        self._tables: dict[str, DataFrame] = {}
        self._derived: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._resolve(name)
        return self._tables[name]

    def derived(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table computed from the dimensions, made once per instance."""
        if name not in self._derived:
            self._derived[name] = make()
        return self._derived[name]

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> Warehouse:
        return cls(frames.__getitem__)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> Warehouse:
        return cls(lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}"))

    @classmethod
    def from_catalog(cls, spark: SparkSession, schema: str = "default") -> Warehouse:
        return cls(lambda name: spark.table(f"{schema}.{name}"))

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        options: Mapping[str, str],
        start: str | None = None,
        end: str | None = None,
        readers: int = 32,
    ) -> Warehouse:
        """Every table is read by ``readers`` tasks: fact tables by ranges of days if a
        range is given, all others by a hash of their key."""

        def resolve(name: str) -> DataFrame:
            parts = jdbc_table(options, name, start, end, readers)
            if "partitionColumn" in parts:
                return spark.read.format("jdbc").options(**parts).load()
            return spark.read.jdbc(
                parts.pop("url"), parts.pop("dbtable"), predicates=jdbc_predicates(name, readers), properties=parts
            )

        return cls(resolve)


def load_clients(path: str) -> dict[str, dict]:
    with open(path, encoding="utf-8") as handle:
        return json.load(handle)


def jdbc_options(clients: Mapping[str, Mapping], client: str, user: str, password: str) -> dict[str, str]:
    """Connection options of a named client; the secret goes to the reader only."""
    if client not in clients:
        raise ValueError(f"unknown client {client!r}; choose one of: {', '.join(sorted(clients))}")
    info = clients[client]
    return {
        "url": f"jdbc:postgresql://{info['host']}:{info['port']}/{info['database']}"
        f"?connectTimeout={CONNECT_TIMEOUT_SECONDS}",
        "user": user,
        "password": password,
        "driver": "org.postgresql.Driver",
        "fetchsize": str(JDBC_FETCH_ROWS),
        "pushDownPredicate": "true",
    }


def jdbc_predicates(name: str, readers: int) -> list[str]:
    """Conditions that deal the rows of a table out to ``readers`` tasks, each row to one."""
    key = {SKU: "used_id", SELLER: "used_id"}.get(name, "day")
    bucket = f"mod(abs(cast(hashtext(coalesce(cast({key} as text), '')) as bigint)), {readers})"
    return [f"{bucket} = {i}" for i in range(readers)]


def jdbc_table(
    options: Mapping[str, str], name: str, start: str | None, end: str | None, readers: int
) -> dict[str, str]:
    ranged = {}
    if start and end and name not in (SKU, SELLER):
        ranged = {
            "partitionColumn": "day",
            "lowerBound": start,
            "upperBound": end,
            "numPartitions": str(readers),
        }
    return {**options, "dbtable": f"public.{name}", **ranged}
