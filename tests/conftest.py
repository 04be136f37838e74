import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from curate.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "curate-tests")


@pytest.fixture(scope="session")
def tables():
    return os.environ.get("CURATE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture
def rows(spark):
    """Values of one or all columns of a result, sorted."""

    def values(frame, *columns):
        found = [tuple(r) for r in frame.select(*columns).collect()] if columns else [tuple(r) for r in frame.collect()]
        found = [r[0] if len(r) == 1 else r for r in found]
        return sorted(found, key=repr)

    return values
