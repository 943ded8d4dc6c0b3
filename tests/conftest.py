import pytest

from compare import local_session
from rolls import Roll


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="session")
def make_roll(spark):
    return lambda rows: Roll(spark, rows)
