import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cxlens.session import local_session
    s = local_session("*", shuffle_partitions=8, app_name="cxlens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fixture_tables(spark):
    from cxlens.sources import derive_marketplace
    return derive_marketplace(spark, SF_SMALL)
