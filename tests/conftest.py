import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortcraft.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", app="cohortcraft-tests", shuffle_partitions=8)
    yield s
    s.stop()


def cp_frame(spark, rows):
    """customer_period frame from (customer, period, revenue) tuples."""
    from cohortcraft.sources import customer_period
    df = spark.createDataFrame(rows, "customer string, period int, revenue double")
    return customer_period(df, "customer", "period", "revenue")
