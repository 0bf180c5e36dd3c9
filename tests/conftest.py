from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from wearhouse.plans.session import build_session

    s = build_session("local[*]", 8, app="wearhouse-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def golden(spark):
    from tests.fixtures import golden_tables

    return golden_tables(spark)


@pytest.fixture(scope="session")
def edge(spark):
    from tests.fixtures import edge_tables

    return edge_tables(spark)
