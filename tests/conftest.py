import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lekhspark.session import build_session

    s = build_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield s
    s.stop()
