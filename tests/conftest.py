import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = os.environ.get("BUSLOOM_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from busloom.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "4"), partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
