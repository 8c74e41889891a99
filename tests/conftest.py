import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from platewise.session import configure, local_session

    s = configure(local_session(4, "platewise-tests"))
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def pieces(monkeypatch):
    """Force the paths for hot groups on small data."""
    from platewise.operators import order, radix

    monkeypatch.setattr(radix, "TASK_VALUES", 100)
    monkeypatch.setattr(radix, "BLOCK_VALUES", 50)
    monkeypatch.setattr(radix, "HELD_VALUES", 500)
    monkeypatch.setattr(order, "ROWS_PER_BUCKET", 20)
