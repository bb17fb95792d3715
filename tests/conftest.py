import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sparkdesk.session import get_session
    s = get_session("local[*]", 8)
    yield s
    s.stop()
