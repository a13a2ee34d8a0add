import pytest

from evidentia.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", "evidentia-tests")
    yield session
    session.stop()
