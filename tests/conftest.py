import pytest

from textloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", "tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
