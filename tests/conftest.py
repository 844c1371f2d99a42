import pytest

from symloom.session import ensure_checkpoint_dir, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, **{"spark.driver.memory": "4g"})
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Rows and a schema string to a DataFrame."""
    return lambda data, schema: spark.createDataFrame(data, schema)


def as_set(df):
    return {tuple(r) for r in df.collect()}
