from __future__ import annotations

import pytest

from quillet.runtime import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
