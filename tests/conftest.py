import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from oracle_check import session
    return session()


@pytest.fixture
def large(spark):
    """Cut every input into tiny slices."""
    from keelson.operators import ordered
    spark.conf.set(ordered.SLICE_CONF, "7")
    yield
    spark.conf.unset(ordered.SLICE_CONF)
