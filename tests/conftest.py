import pytest

from termloom.session import build_session, ship


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
