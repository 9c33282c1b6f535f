import pytest

from quillon.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="4", partitions=4, app="quillon-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
