import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pkgatlas.session import local_session

    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def value(spark):
    """Evaluate one column over given rows of text or numbers."""
    from pyspark.sql import functions as F

    def run(make, items, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
        return [r[0] for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").select("o").collect()]

    return run
