import os
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, os.environ.get("PYTHONPATH", "")]))
sys.path.insert(0, REPO)

DATA = os.environ.get("SKARN_TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from skarn.session import local_session

    session = local_session(memory="4g", partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def sf01():
    return f"{DATA}/sf0.01"
