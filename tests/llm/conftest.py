import pytest

from tests.llm import helpers


@pytest.fixture(scope="session")
def docs(spark):
    return helpers.frame(spark, helpers.rows()).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], helpers.SCHEMA)
