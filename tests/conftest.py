import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rosterlens.session import local_session  # noqa: E402
from rosterlens.sources.bindings import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)


@pytest.fixture
def rows():
    """Rows of a frame as a list of dicts."""
    return lambda df: [r.asDict() for r in df.collect()]
