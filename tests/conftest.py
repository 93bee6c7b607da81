import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from granulake.session import build_session, prepare

    return prepare(build_session("granulake-tests"))


@pytest.fixture(scope="session")
def duck():
    import oracle

    return oracle.connect(oracle.SF_DIR)
