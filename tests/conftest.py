import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seqloom.session import build_session  # noqa: E402

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("*", shuffle_partitions=8, app="seqloom-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
