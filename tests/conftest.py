import pytest

from weirloom.session import session


@pytest.fixture(scope="session")
def spark():
    return session("tests", "4")
