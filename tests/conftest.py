import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from ordermill import get_session
    scratch = tempfile.mkdtemp(prefix="ordermill-tests-")
    s = get_session("local[*]", app="ordermill-tests", shuffle_partitions=8,
                    conf={"spark.driver.memory": "8g",
                          "spark.checkpoint.dir": os.path.join(scratch, "checkpoints"),
                          "spark.local.dir": os.path.join(scratch, "local")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
