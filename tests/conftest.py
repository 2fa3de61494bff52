import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_session, shared_dir
    s = get_session("local[*]", 8)
    shared_dir(s)
    yield s


SF_SMALL = "/root/testdata/sf0.001"
