import pytest

from clausewright.session import spark_session


@pytest.fixture(scope="session")
def spark():
    session = spark_session("tests", cpus=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
