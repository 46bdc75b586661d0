import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tidewell.session import local_session, prepare

    return prepare(local_session(cores="4", partitions=4, memory="6g"))
