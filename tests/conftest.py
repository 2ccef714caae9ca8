import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from webtables import build_session

    session = build_session(
        "tests", "local[8]", spark_driver_memory="6g", spark_sql_shuffle_partitions="4", spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
