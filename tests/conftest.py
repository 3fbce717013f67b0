from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import __spark_entry__  # noqa: E402,F401 - ships the package to the workers
from siftwell.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g", spark__ui__enabled="false"
    )
    session.sparkContext.setLogLevel("FATAL")
    yield session
    session.stop()
