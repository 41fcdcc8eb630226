"""One small session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from framewright.session import build_session

    home = tmp_path_factory.mktemp("spark")
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir=str(home / "warehouse"), spark__checkpoint__dir=str(home / "shared"), spark__driver__memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
