import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagemill.session import local  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local(4, "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
