import pytest

from pressgraph.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(name="tests", memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
