import os
import sys
import time

import pytest

# Naive datetimes in the tests mean UTC wall-clock time (as the session's
# time zone does); PySpark converts them with the process zone, so pin it.
os.environ["TZ"] = "UTC"
time.tzset()

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlane.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=8, app="fleetlane-tests")
    yield s
    s.stop()
