import pytest

from fleetwatch.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cores="4")
