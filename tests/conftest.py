import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from shopfloor.session import build_session

    s = build_session(app="shopfloor-tests", master="local[4]", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="shopfloor-ckpt-")})
    yield s


def rows(df, *cols):
    """Collect selected columns as sorted tuples (order-insensitive)."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=repr)


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
