import pytest

from .compare import session


@pytest.fixture(scope="session")
def spark():
    return session()
