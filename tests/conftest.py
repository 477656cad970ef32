import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from meritflow.session import get_spark
    extra = {}
    if not os.environ.get("SPARK_CHECKPOINT_DIR"):
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="meritflow-test-ckpt-")
    s = get_spark("local[4]", app="meritflow-tests", shuffle_partitions=8, extra=extra)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from meritflow.plans.check import duckdb_connection
    return duckdb_connection(SF_SMALL)
