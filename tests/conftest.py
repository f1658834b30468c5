import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dimweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=8, app="dimweave-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fixture_tables(spark):
    from dimweave.sources.tables import from_rows
    from tests.fixture import fixture_rows

    return from_rows(spark, fixture_rows())
