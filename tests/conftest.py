"""One local session for the whole suite."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from wavecrest.session import local_session

    session = local_session("local[4]", shuffle_partitions=4, driver_memory="3g")
    yield session
    session.stop()
