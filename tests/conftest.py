import os
import shutil
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tideline.session import session

    tmp = tempfile.mkdtemp(prefix="tideline-tests-")
    s = session("local[4]", 4, **{"spark.checkpoint.dir": f"{tmp}/shared", "spark.sql.warehouse.dir": f"{tmp}/warehouse", "spark.default.parallelism": "4"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
    shutil.rmtree(tmp, ignore_errors=True)


@pytest.fixture(scope="session")
def sf():
    return SF
