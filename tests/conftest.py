import pytest

from corpusmill.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(4, **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield spark
    spark.stop()
