"""Plan shapes that the scale design relies on (read from ``explain``)."""

import contextlib
import io
import os
import re

import pytest

import __spark_entry__ as E
from conftest import SF001

pytestmark = pytest.mark.skipif(not os.path.exists(SF001), reason="test data")


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_retention_summary_reads_the_fact_once_without_joins(spark):
    p = plan(E.queries()["retention_summary"](spark, SF001))
    # once whole, and the period column alone for the array of periods, without a shuffle of it
    assert {re.sub("_ntz", "", x) for x in re.findall(r"^ReadSchema: struct<(.*)>", p, re.M)} == {
        "o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp", "o_orderdate:timestamp"}
    assert "Join" not in p
    # the grain aggregation is partial before its shuffle (skewed customers combine map-side)
    assert "partial_sum" in p
    # every window has a partition key: nothing but the periods themselves comes together in one task
    assert all("[customer" in w for w in re.findall(r"^Arguments: \[lag.*$", p, re.M))


def test_summary_of_3000_daily_periods(spark):
    """Days as periods, with gaps: the rows equal a plain count, and no window runs over the step table."""
    from collections import defaultdict

    from cohortcraft.operators import retention
    from cohortcraft.sources import customer_period

    days = [d for d in range(4000) if d % 4 != 2]
    rows = [(f"c{(d * 7 + k * k) % 41}", d, float(k + 1)) for d in days for k in range(4)] + [(None, 5, 2.0)]
    df = spark.createDataFrame(rows, "customer string, day int, value double")
    got = retention.summary(customer_period(df, "customer", "day", "value"), "day")
    assert len(re.findall(r"\bWindow\b", plan(got, "simple").split("Initial Plan")[0])) == 1
    revenue = defaultdict(lambda: defaultdict(float))
    for c, d, v in rows:
        revenue[d][c] += v
    found = {r["day"]: r for r in got.collect()}
    assert sorted(found) == days
    for before, d in zip([None, *days], days):
        now, was = ({c: v for c, v in revenue[x].items() if c} if x is not None else {} for x in (d, before))
        r = found[d]
        assert r["net_revenue"] == sum(revenue[d].values()) and r["total_customers"] == len(now)
        assert r["new_customers"] == (len(now.keys() - was.keys()) if before is not None else 0)
        assert r["lost_customers"] == len(was.keys() - now.keys())
        assert r["lost_cust_revenue"] == sum(was[c] for c in was.keys() - now.keys())


def test_bucketed_fact_has_no_exchange_on_the_customer(spark):
    """Also after new periods were appended; same rows as from the fact itself."""
    import uuid

    from cohortcraft.operators import retention
    from cohortcraft.sources import customer_period_from_orders
    from cohortcraft.sources.bucketed import append_periods, read_fact, write_fact
    from pyspark.sql import functions as F

    cp = customer_period_from_orders(spark, SF001)
    last = cp.agg(F.max("period")).first()[0]
    table = f"fact_{uuid.uuid4().hex}"
    write_fact(cp.filter(F.col("period") < last), table, 4)
    append_periods(cp.filter(F.col("period") == last), table)
    fact = read_fact(spark, table)
    for fn in (retention.summary, retention.transitions, retention.new_by_anti_join, retention.existing_by_semi_join):
        got = fn(fact)
        assert not re.findall(r"Exchange hashpartitioning\(customer", plan(got, "simple")), fn.__name__
        assert sorted(map(str, got.collect())) == sorted(map(str, fn(cp).collect()))
    spark.sql(f"DROP TABLE {table}")


def test_loan_scan_reads_only_needed_columns(spark):
    p = plan(E.queries()["value_counts"](spark, SF001))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in p


def test_top_categories_limits_before_exchange(spark):
    p = plan(E.queries()["top_categories"](spark, SF001))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_top_k_inspection_is_take_ordered(spark):
    p = plan(E.queries()["extreme_income"](spark, SF001), "simple")
    assert "TakeOrderedAndProject" in p


@pytest.fixture
def large(spark):
    """Plans as for large data: nothing is broadcast for a small estimate."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, old)


@pytest.mark.parametrize("key", ["iqr_fence", "describe_numeric", "box_stats", "unverified_top_income"])
def test_quantile_plans_leave_the_data_in_place(large, key):
    p = plan(E.queries()[key](large, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    if key != "unverified_top_income":  # (its table is a join)
        assert "SortMergeJoin" not in p


@pytest.mark.parametrize("key", ["customer_transitions", "new_customers_anti", "existing_customers_semi", "customers_except"])
def test_facts_are_not_shuffled_on_the_period(large, key):
    p = plan(E.queries()[key](large, SF001))
    for exchange in re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\(period#\d+, \d+\)", p, re.M):
        assert "customer" not in exchange


def test_preparation_keeps_nothing_in_executor_storage(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    E.queries()["loan_prepared"](spark, SF001).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
