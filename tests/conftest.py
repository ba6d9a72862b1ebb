import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def hot(spark):
    """Every key above 7 rows counts as hot."""
    spark.conf.set("curvekit.probeBytes", "0")
    spark.conf.set("curvekit.slabRows", "7")
    yield spark
    spark.conf.unset("curvekit.probeBytes")
    spark.conf.unset("curvekit.slabRows")
