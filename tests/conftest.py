import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from viewgraph.session import local_session

    session = local_session(8, "tests", spark__sql__shuffle__partitions=4, spark__driver__memory="6g")
    yield session
    session.stop()
