import pytest

from skeinwork.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", 4, spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    yield session
    session.stop()
