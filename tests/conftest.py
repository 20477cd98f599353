import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from terrace.session import build_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "4", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("OFF")
    ship(session)
    return session
