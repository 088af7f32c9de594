import pytest

from reelspark.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__enabled="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
