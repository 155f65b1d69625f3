import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from outlane.plans import load_all  # noqa: E402
from outlane.session import local_session  # noqa: E402
from outlane.sources.tables import Tables  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "outlane-tests", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.conf.set("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield session
    session.stop()


@pytest.fixture()
def tables(spark):
    return Tables(spark, FOLDER)


def rows(df):
    return sorted(tuple(r) for r in df.collect())
