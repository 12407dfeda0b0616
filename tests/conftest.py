import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL_SF = "/root/testdata/sf0.001"
MID_SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from skyledger.session import get_session, checkpoint_dir
    s = get_session(master="local[4]", shuffle_partitions=4, app_name="skyledger-tests")
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from skyledger.plans.compare import duck_connect
    return duck_connect(SMALL_SF)


def df_of(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


TS = dt.datetime
