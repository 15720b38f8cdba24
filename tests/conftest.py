import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tsumugi.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return ship(local_session(cpus=4, memory="3g", partitions=4))


@pytest.fixture(scope="session")
def sf():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path
