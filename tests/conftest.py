import pytest

from maskwright.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("maskwright-tests")


@pytest.fixture(scope="session")
def key(spark):
    from maskwright.plans.base import test_key

    return test_key()


@pytest.fixture
def apply(spark):
    """Evaluate a column expression over a list of texts."""
    from pyspark.sql import functions as F

    def run(fn, texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        rows = df.select("i", fn(F.col("text")).alias("r")).orderBy("i").collect()
        return [r.r for r in rows]

    return run
