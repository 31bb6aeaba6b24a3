import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridloom.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("4", 4, **{"spark.checkpoint.dir": tmp_path_factory.mktemp("shared").as_uri(), "spark.sql.warehouse.dir": tmp_path_factory.mktemp("warehouse").as_uri()})
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()
