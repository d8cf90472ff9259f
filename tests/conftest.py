import pytest

from tendrel.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cpus=4, partitions=4)
