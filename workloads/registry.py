"""Query registration: one function and, where SQL can say it, one oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from attestra.session import configure, spread

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

SPREAD_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}


class Tables:
    """The given parquet tables of one directory, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table, SPREAD_KEYS[name]) if name in SPREAD_KEYS else table


@dataclass(frozen=True)
class Registered:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Registered] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register ``function(tables) -> DataFrame`` under a name with its oracle."""

    def register(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        text = None
        if sql is not None:
            body = sql.strip()
            text = body if not ctes else "WITH " + ",".join(ctes) + (body if body.startswith(",") else "\n" + body)
        QUERIES[name] = Registered(lambda spark, folder: function(Tables(spark, folder)), text)
        return function

    return register
