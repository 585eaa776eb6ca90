import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    import os

    os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
    from lotwise.session import local_session

    session = local_session(4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
