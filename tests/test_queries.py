"""Every registered query beside its SQL twin, on the smallest tables."""

import os

import pytest

from tablewright.plans import ORACLES, QUERIES
from tests.oracle import TESTDATA, compare, connect

FOLDER = f"{TESTDATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, FOLDER) is None


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
