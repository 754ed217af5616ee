import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from larder.session import session

    s = session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="spark-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
