import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for p in (ROOT, ROOT / "tests", ROOT / "tests" / "llm"):
    sys.path.insert(0, str(p))


@pytest.fixture(scope="session")
def spark():
    from strataflow.session import local_session, ship

    s = local_session(4, 4)
    ship(s)
    yield s
    s.stop()
