"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    own = local_session(4, 4)
    own.sparkContext.setLogLevel("ERROR")
    own.sparkContext.environment["PYTHONPATH"] = str(ROOT)
    yield own
    own.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return "/root/testdata/sf0.001"
