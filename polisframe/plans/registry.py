"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from polisframe.derive import city_model
from polisframe.model import CityModel
from polisframe.plans.sql_model import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Register ``fn(model) -> DataFrame``; ``sql`` may use the model's tables by name."""

    def register(fn: Callable[[CityModel], DataFrame]):
        if name in QUERIES:
            raise KeyError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(city_model(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_tables(sql, recursive)
        return fn

    return register
