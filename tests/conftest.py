import logging
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from glassledger.session import local_session, ship_package

    s = local_session(8, "tests")
    s.sparkContext.setLogLevel("OFF")
    logging.getLogger("py4j").setLevel(logging.CRITICAL)
    ship_package(s)
    yield s
    s.stop()
