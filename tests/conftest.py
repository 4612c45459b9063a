import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from drift_engine import session


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[4]", 4, "6g")
    session.ship_package(s)
    yield s
    s.stop()
