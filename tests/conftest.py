import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from tracewright import session  # noqa: E402

CHUNK = "16"


@pytest.fixture(scope="session")
def spark():
    s = session.get_spark(8, partitions=4, app="tests")
    # small chunks, so that every run spans several of them
    s.conf.set(session.CHUNK_KEY, CHUNK)
    yield s
    s.stop()
