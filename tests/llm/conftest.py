import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs(spark):
    from helpers import frame

    return frame(spark).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    from helpers import frame

    return frame(spark, [])
