import pytest

from plumbline.plans.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8)
