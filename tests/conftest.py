import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from gridweave.session import checkpoint_dir, get_spark

    s = get_spark("local[4]", 8, app_name="gridweave-tests",
                  conf={"spark.sql.adaptive.coalescePartitions.enabled": "true"})
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="gw-test-", dir="/tmp")


def rows(df, *cols):
    """Sorted list of tuples (all columns unless given)."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
