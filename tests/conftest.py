from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from weft.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="weft-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from weft.oracle import duck

    return duck(SMALL)
