"""Every registered query with SQL runs on the small tables in both engines."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, printed
from fieldspark.verify.registry import REGISTRY
from fieldspark.verify.stages import Stages

from .conftest import SMALL

# Ten sites only: none lie within 10 km of each other, and no two share a footprint value.
EMPTY_HERE = {"spatial_weights", "distance_self_join", "natural_inner_join"}


@pytest.fixture(scope="module")
def stages(spark):
    return Stages(spark, SMALL)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) & set(REGISTRY)))
def test_matches_sql(stages, db, name):
    got = queries()[name].frame(stages).toPandas()
    want = db.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert printed(got) == printed(want)
    assert len(got) or name in EMPTY_HERE


def test_entry(spark):
    assert entry(spark).count() > 0
