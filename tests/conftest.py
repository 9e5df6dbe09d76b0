import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from leaksieve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", "tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return session


@pytest.fixture
def units(spark):
    def make(texts, uri="f.txt"):
        rows = [(str(i), t[0], t[1]) if isinstance(t, tuple) else (str(i), uri, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "unit_id string, uri string, text string")
    return make
