import pytest


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached(spark):
    """What a module's fixtures cache would be found by tests of other modules that nothing is left in memory."""
    yield
    spark.catalog.clearCache()
