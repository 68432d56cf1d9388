import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"
AS_OF = "1998-06-15 10:30:00"


@pytest.fixture(scope="session")
def spark():
    from lodgelake.session import build_session, checkpoint_dir

    s = build_session("local[8]", app="lodgelake-tests", shuffle_partitions=8)
    checkpoint_dir(s)  # tests only: a local folder, since no cluster folder is configured
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="lodgelake-test-")


@pytest.fixture(scope="session")
def views(spark):
    from lodgelake.sources.views import DriverViews

    return DriverViews(spark, SF_SMALL)


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
