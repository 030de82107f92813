import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wardline.session import get_session
    s = get_session("local[2]", app="wardline-tests", shuffle_partitions=4)
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
