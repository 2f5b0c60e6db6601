"""One local session for all tests."""

import pytest

from brindle.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, spark__sql__warehouse__dir="/tmp/brindle-warehouse")
    yield session
    session.stop()
