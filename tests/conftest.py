import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_spark
    s = get_spark("local[*]", app="quarry-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="quarry-tests-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def cat(spark):
    from quarry.catalog import Catalog
    return Catalog.from_fixture_dir(spark, SF_SMALL)
