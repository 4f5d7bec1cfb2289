import pytest

from stipendia.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", 4, "8g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
