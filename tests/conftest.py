import pytest

from workload.compare import make_session


@pytest.fixture(scope="session")
def spark():
    session = make_session("4", "4")
    yield session
    session.stop()
