import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from waymark.session import local_session, ship_code  # noqa: E402

SMALL = os.environ.get("WAYMARK_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g")
    ship_code(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL
