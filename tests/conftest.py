import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from jobtide.session import build_session
    scratch = tempfile.mkdtemp(prefix="jobtide-test-")
    os.environ.setdefault("JOBTIDE_SCRATCH", scratch)
    s = build_session("local[4]", 4, app_name="jobtide-tests",
                      extra={"spark.local.dir": scratch, "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse")})
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]
