"""Registered queries: a name, a Spark callable over the given tables and, where SQL can say it, its twin."""
from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare


class Tables:
    """The given Parquet tables of one folder, scanned lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, fn, sql, tuple(covers.split()))
        return fn
    return wrap


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: q.build(Tables(spark, folder))
