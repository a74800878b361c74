import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from molweave.session import clear_scratch, get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", os.environ.get("TEST_CPUS", "8"), **{"spark.sql.shuffle.partitions": "4"})
    yield session
    clear_scratch(session)
    session.stop()
