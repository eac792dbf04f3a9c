import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from lagscope.session import get_session
    s = SparkSession.getActiveSession()
    if s is None:
        s = (SparkSession.builder.master("local[*]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    s = get_session()
    from lagscope.session import checkpoint_dir
    checkpoint_dir(s)
    return s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="lagscope-t-")
