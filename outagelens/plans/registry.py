"""Query registry: name -> (Spark builder, DuckDB oracle SQL, inventory IDs).

Every builder takes a ``Tables`` handle and returns a lazy DataFrame over the
whole input tables.  The oracle SQL runs in DuckDB against the same parquet
files (views named like the tables).
"""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from ..sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    ids: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, Query] = {}

_MODULES = [
    "outagelens.plans.q_columns",
    "outagelens.plans.q_rows",
    "outagelens.plans.q_joins",
    "outagelens.plans.q_aggregates",
    "outagelens.plans.etl",
    "outagelens.plans.etl_sites",
    "outagelens.plans.etl_items",
    "outagelens.plans.etl_outages",
    "outagelens.plans.q_stats",
    "outagelens.plans.q_metrics",
    "outagelens.plans.q_learning",
    "outagelens.plans.q_tuning",
    "outagelens.plans.q_neighbors",
    "outagelens.plans.q_forest",
]


def register(name: str, sql: str | None = None, ids=()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(ids))
        return fn
    return deco


def load_all() -> dict[str, Query]:
    for mod in _MODULES:
        importlib.import_module(mod)
    return REGISTRY


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return q.build(Tables(spark, sf_dir))
    run.__name__ = q.name
    return run
