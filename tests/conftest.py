import pytest

from tidemark.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = local_session(8, app="tests", **{"spark.sql.warehouse.dir": str(warehouse)})
    yield session
    session.stop()
