import pytest

from tools.session import session


@pytest.fixture(scope="session")
def spark():
    return session("4", "4")
