import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quire.session import get_session, ship

    session = get_session(4, "quire-tests", shuffle_partitions=4)
    ship(session)
    yield session
    session.stop()
