import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from tremora.session import build_session

    session = build_session(
        f"local[{os.environ.get('TEST_CORES', '8')}]",
        "tests",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="tremora-checkpoints-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
