import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stayrate.session import local_session

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "stayrate-tests")
    yield session


@pytest.fixture(scope="session")
def small():
    """Folder of the smallest tables."""
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def medium():
    return f"{TESTDATA}/sf0.01"
