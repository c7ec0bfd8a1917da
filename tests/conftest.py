import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import functions defined in the test modules.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [ROOT, os.path.join(ROOT, "tests")] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p])

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from feedloom.session import build_session
    s = build_session("local[4]", app="feedloom-tests", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="feedloom-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="feedloom-test-")


def rows(df, *cols):
    """Collected rows as plain tuples (optionally a column subset)."""
    if cols:
        df = df.select(*cols)
    return [tuple(r) for r in df.collect()]


def one(df, col):
    r = df.select(col).collect()
    assert len(r) == 1, r
    return r[0][0]
