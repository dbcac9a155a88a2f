import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# workers import this package and the tests' own classes
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

from segloom.util import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", spark__sql__shuffle__partitions="4", spark__default__parallelism="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
