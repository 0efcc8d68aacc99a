import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))


@pytest.fixture(scope="session")
def spark():
    from calorway.session import build_session
    session = build_session("local[4]", shuffle_partitions=4, driver_memory="6g", app="calorway-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
