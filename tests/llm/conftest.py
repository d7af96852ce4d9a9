import pytest


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached(spark):
    """Other modules look at what is kept in memory."""
    yield
    spark.catalog.clearCache()
