from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from loomwork.session import local_session, shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", 4, **{"spark.sql.shuffle.partitions": "4"})
    shared_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf(spark):
    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no test tables")
    return str(d)
