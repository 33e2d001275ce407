import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from qaloom.session import build_session

    conf = {
        "spark__sql__shuffle__partitions": "4",
        "spark__default__parallelism": "4",
        "spark__driver__memory": "4g",
        "spark__checkpoint__dir": str(tmp_path_factory.mktemp("checkpoints")),
        "spark__sql__warehouse__dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    s = build_session(os.environ.get("TEST_MASTER", "local[4]"), **conf)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
