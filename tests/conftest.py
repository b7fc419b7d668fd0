import pytest

from finlake.session import local_session
from tests.oracle import SF_DIR, connect


@pytest.fixture(scope="session")
def spark():
    return local_session("8")


@pytest.fixture(scope="session")
def con():
    return connect(SF_DIR)
