import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from lodestone.session import build_session

    build_session("local[4]", 4)
    session = SparkSession.getActiveSession()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
