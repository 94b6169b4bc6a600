import pytest

from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    spark = session(shuffle=4)
    yield spark
    spark.stop()
