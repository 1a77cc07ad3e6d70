import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    import os

    os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parent.parent) + ":" + os.environ.get("PYTHONPATH", "")
    from parlance.session import local_session

    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
