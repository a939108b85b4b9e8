import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from paperloom.session import build_session

    s = build_session("paperloom-tests", cpus=4, **{"spark.driver.memory": "4g"})
    yield s
    s.stop()
