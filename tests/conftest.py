import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from textmill.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "8", memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
