import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from checks import compare, fixtures  # noqa: E402
from tradeweave.plans.study import Study  # noqa: E402
from tradeweave.sources import schemas  # noqa: E402
from tradeweave.sources.tables import TradeTables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = compare.session("4")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    return spark


@pytest.fixture(scope="session")
def study(spark):
    return fixtures.study(spark, SMALL)


@pytest.fixture
def make_study(spark):
    """A study over literal rows; tables that are not given are empty."""

    def make(**rows):
        tables = {}
        for name, schema in schemas.TABLES.items():
            given = rows.get(name, [])
            full = [tuple(r.get(f.name) for f in schema.fields) for r in given]
            tables[name] = spark.createDataFrame(full, schema)
        return Study(TradeTables(**tables))

    return make


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()
