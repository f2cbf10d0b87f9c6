import pytest

from tapeloom.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
