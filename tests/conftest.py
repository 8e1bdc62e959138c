import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def make_session():
    from pulsetrail.session import local_session
    return local_session(cores=int(os.environ.get("TEST_CPUS", "8")))


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()
