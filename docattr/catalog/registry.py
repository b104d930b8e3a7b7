"""Registry of queries and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            SQL[name] = dedent(sql).strip()
        return fn

    return register


#: Tasks the text tables are dealt to before row-local work, for small files that are read as one split; unset, they are as read.
READ_TASKS = "docattr.catalog.tasks"
TEXT_TABLES = {"documents", "pages", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get(READ_TASKS, None)
    return df.repartition(int(tasks)) if tasks and name in TEXT_TABLES else df
