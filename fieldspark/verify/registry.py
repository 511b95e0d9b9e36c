"""Registry of checked queries: a Spark function, a result specification and, where SQL can say it, SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .columns import shape_frame, shape_sql
from .oracle import with_views
from .stages import Stages


@dataclass
class Query:
    name: str
    spec: str
    build: Callable[[Stages], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, directory: str) -> DataFrame:
        return self.frame(Stages(spark, directory))

    def frame(self, stages: Stages) -> DataFrame:
        """The result over given stages; sharing them between queries reuses stored tables."""
        return shape_frame(self.build(stages), self.spec)


REGISTRY: dict[str, Query] = {}


def query(name: str, spec: str, sql: str | None = None):
    """Register the decorated function; ``sql`` may use the views of ``oracle``."""

    def add(build: Callable[[Stages], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(name, spec, build, sql)
        return build

    return add


def oracle_text(item: Query) -> str | None:
    return None if item.sql is None else with_views(shape_sql(item.sql, item.spec))
