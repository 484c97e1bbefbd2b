import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import duck
from strandline.session import build_session

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", 8, "6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    return duck(SMALL)


@pytest.fixture(scope="session")
def sf():
    return SMALL
