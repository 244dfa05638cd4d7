"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from siftstone.session import local_session

    session = local_session(cpus=4, partitions=4, memory="4g")
    yield session
    session.stop()
