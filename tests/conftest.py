"""One small session for all tests."""

import pytest

from corvane.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """A local session with few partitions."""
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield session
    session.stop()
