"""Small tables with the awkward rows that every operator must take."""

import pytest
from llm_rows import DOCS, table

from newsprism.session import reach_workers


@pytest.fixture(scope="session")
def awkward(spark):
    reach_workers(spark)
    return table(spark, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    reach_workers(spark)
    return table(spark, [])
