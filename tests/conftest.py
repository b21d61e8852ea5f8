import pytest

from quire.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "quire-tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a DataFrame from rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
