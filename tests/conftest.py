import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillroll.schema import RAW_SCHEMA  # noqa: E402
from tillroll.session import ensure_checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="tillroll-tests")
    ensure_checkpoint_dir(s)
    yield s


def rows(spark, data, schema=RAW_SCHEMA):
    """Build a raw transaction frame from tuples in RAW_SCHEMA order (prices as Decimal)."""
    return spark.createDataFrame(data, schema)


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)
