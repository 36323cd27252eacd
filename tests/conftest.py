import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from riskframe.session import build_session
    s = build_session(master="local[8]", shuffle_partitions=8, app_name="riskframe-tests")
    yield s
    s.stop()
