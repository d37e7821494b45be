import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))



@pytest.fixture(scope="session")
def spark():
    from tonality.session import get_spark
    s = get_spark("local[4]", app="tonality-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tonality-test-ckpt-"),
                         "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tonality-test-wh-")})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="tonality-test-")
