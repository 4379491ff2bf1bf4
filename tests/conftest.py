import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]
os.environ.setdefault("TZ", "UTC")

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from sondegrid.session import get_session

    s = get_session("tests", "local[8]", 4, **{"spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false", "spark.sql.autoBroadcastJoinThreshold": "10m"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    from sondegrid.session import clean_up

    clean_up(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"
