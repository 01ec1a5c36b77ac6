import pytest

from tidewatch.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
