import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("TIDEWRIGHT_TEST_DIR", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


@pytest.fixture(scope="session")
def spark():
    import twin
    from tidewright.session import prepare

    s = prepare(twin.session())
    yield s
    s.stop()


@pytest.fixture
def large_path(spark):
    """Force the large-data path: nothing counts as small and blocks hold a few hundred rows."""
    from tidewright.session import BLOCK_ROWS_KEY, SMALL_BYTES_KEY

    spark.conf.set(SMALL_BYTES_KEY, "0")
    spark.conf.set(BLOCK_ROWS_KEY, "300")
    yield
    spark.conf.unset(SMALL_BYTES_KEY)
    spark.conf.unset(BLOCK_ROWS_KEY)
