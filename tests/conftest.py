from __future__ import annotations

import signal
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from scorekit.session import local_session  # noqa: E402


#: Seconds that one test may take. A call into the JVM that was interrupted leaves its answer behind for the next call, so
#: the run ends there.
LIMIT = 900


@pytest.fixture(autouse=True)
def time_limit(request):
    def stop(*_):
        pytest.exit(f"{request.node.nodeid} took more than {LIMIT} s", returncode=3)

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(LIMIT)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def column(df, name, order=None):
    """Values of one column, ordered by another."""
    rows = df.orderBy(order).collect() if order else df.collect()
    return [r[name] for r in rows]
