"""Retention semantics: the quirks of SURVEY §2.13, the identities of §5
and the published sf0.01 values of FIXTURES §2."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF01, cp_frame
from cohortcraft.operators import retention as R
from cohortcraft.sources import customer_period_from_orders


def rows_by_year(df):
    return {r["year"]: r.asDict() for r in df.collect()}


def flags(spark, rows):
    t = R.transitions(cp_frame(spark, rows)).collect()
    return {(r["customer"], r["year"]): r for r in t}


def test_returner_is_lost_then_new_again(spark):
    f = flags(spark, [("a", 1, 1.0), ("a", 3, 1.0), ("b", 1, 1.0), ("b", 2, 1.0), ("b", 3, 1.0)])
    assert f[("a", 1)]["is_lost_next"] and not f[("b", 1)]["is_lost_next"]
    assert f[("a", 3)]["is_new"] and not f[("a", 3)]["is_existing"]
    assert f[("b", 3)]["is_existing"]
    s = rows_by_year(R.summary(cp_frame(spark, [("a", 1, 1.0), ("a", 3, 1.0), ("b", 1, 1.0),
                                                ("b", 2, 1.0), ("b", 3, 1.0)])))
    assert s[2]["lost_customers"] == 1 and s[3]["new_customers"] == 1 and s[3]["existing_cust"] == 1


def test_gap_year_uses_previous_observed_period(spark):
    cp = cp_frame(spark, [("a", 2015, 5.0), ("b", 2015, 7.0), ("a", 2017, 11.0)])
    s = rows_by_year(R.summary(cp))
    assert set(s) == {2015, 2017}
    assert s[2017]["new_customers"] == 0 and s[2017]["lost_customers"] == 1
    assert s[2017]["lost_cust_revenue"] == 7.0
    assert s[2017]["exist_cust_growth"] == 6.0
    sp = {r["period"]: r for r in R.period_spine(cp).collect()}
    assert sp[2017]["prev_period"] == 2015 and sp[2015]["next_period"] == 2017


@pytest.mark.parametrize("second", [[("c", 2, 1.0)], [("a", 2, 3.0), ("b", 2, 4.0)]])
def test_nobody_stays_or_nobody_new_gives_zero(spark, second):
    s = rows_by_year(R.summary(cp_frame(spark, [("a", 1, 1.0), ("b", 1, 2.0)] + second)))
    if len(second) == 1:      # disjoint: nobody stays
        assert s[2]["current_revenue_exist_cust"] == 0 and s[2]["existing_cust"] == 0
        assert s[2]["lost_customers"] == 2
    else:                     # identical: nobody new, nobody lost
        assert s[2]["new_customers"] == 0 and s[2]["new_cust_revenue"] == 0 and s[2]["lost_customers"] == 0


def test_duplicate_customer_period_is_summed(spark):
    s = rows_by_year(R.summary(cp_frame(spark, [("a", 1, 1.5), ("a", 1, 2.5)])))
    assert s[1]["total_customers"] == 1 and s[1]["net_revenue"] == 4.0


def test_null_customer_in_revenue_not_in_counts(spark):
    cp = cp_frame(spark, [("a", 1, 1.0), (None, 1, 10.0), ("a", 2, 2.0), (None, 2, 20.0)])
    s = rows_by_year(R.summary(cp))
    assert s[1]["net_revenue"] == 11.0 and s[1]["total_customers"] == 1
    assert s[2]["new_customers"] == 0 and s[2]["current_revenue_exist_cust"] == 2.0
    assert rows_by_year(R.customers_by_period(cp))[2]["total_customers"] == 1


def test_single_period(spark):
    s = rows_by_year(R.summary(cp_frame(spark, [("a", 1, 1.0), ("b", 1, 2.0)])))
    assert s[1]["current_revenue_exist_cust"] == 3.0 and s[1]["existing_cust"] == 2
    assert s[1]["new_customers"] == 0 and s[1]["lost_customers"] == 0


def test_summary_column_order(spark):
    df = R.summary(cp_frame(spark, [("a", 1, 1.0)]))
    assert df.columns == ["year"] + R.SUMMARY_COLUMNS


@pytest.mark.skipif(not os.path.exists(SF01), reason="test data")
def test_published_values_and_identities_sf001(spark):
    cp = customer_period_from_orders(spark, SF01)
    s = rows_by_year(R.summary(cp))
    # FIXTURES.md §2 (values equal in Spark and DuckDB)
    assert s[1995]["total_customers"] == 1174 and s[1995]["net_revenue"] == 558998021.21
    assert s[1996]["new_customers"] == 255 and s[1996]["new_cust_revenue"] == 123758841.58
    assert s[1996]["current_revenue_exist_cust"] == 436025764.00
    assert s[1996]["prev_revenue_exist_cust"] == 422519085.79
    assert s[1996]["lost_customers"] == 261 and s[1996]["lost_cust_revenue"] == 136478935.42
    assert s[2001]["lost_customers"] == 480 and s[2001]["lost_cust_revenue"] == 245881141.41
    years = sorted(s)
    for prev, cur in zip(years, years[1:]):
        c, p = s[cur], s[prev]
        assert c["total_customers"] == c["new_customers"] + c["existing_cust"]
        assert abs(c["net_revenue"] - (c["new_cust_revenue"] + c["current_revenue_exist_cust"])) < 1e-6
        assert p["total_customers"] - c["lost_customers"] == c["existing_cust"]
    # set-operation route and anti/semi joins agree with the window route
    ex = {r["year"]: r for r in R.except_counts(cp).collect()}
    for y in years[1:]:
        assert ex[y]["new_customers"] == s[y]["new_customers"]
        assert ex[y]["lost_customers"] == s[y]["lost_customers"]
    anti = {r["year"]: r["n"] for r in R.new_by_anti_join(cp).groupBy("year").agg(F.count("*").alias("n")).collect()}
    semi = {r["year"]: r["n"] for r in R.existing_by_semi_join(cp).groupBy("year").agg(F.count("*").alias("n")).collect()}
    for y in years[1:]:
        assert anti[y] == s[y]["new_customers"] and semi[y] == s[y]["existing_cust"]


@pytest.mark.skipif(not os.path.exists(SF01), reason="test data")
def test_independent_of_partition_count(spark):
    base = None
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got = sorted(tuple(r) for r in R.summary(customer_period_from_orders(spark, SF01)).collect())
        base = base or got
        assert got == base
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_loyalty_and_rollup(spark):
    cp = cp_frame(spark, [("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 2.0), (None, 1, 5.0)])
    loy = {r["n_periods"]: r for r in R.loyalty(cp).collect()}
    assert loy[2]["n_customers"] == 1 and loy[1]["pct_customers"] == 50.0
    roll = {r["year"]: r for r in R.revenue_rollup(cp).collect()}
    assert roll[None]["is_total"] and roll[None]["net_revenue"] == 9.0 and roll[1]["net_revenue"] == 8.0


def test_long_metrics_equal_the_single_metric_tables(spark):
    cp = cp_frame(spark, [("a", 1, 1.0), ("a", 3, 4.0), ("b", 1, 2.0), ("b", 2, 5.0), ("c", 2, 7.0),
                          ("c", 3, 1.5), (None, 2, 9.0)])
    long = {(r["year"], r["metric"]): r["value"] for r in R.metrics_long(cp).collect()}
    singles = {
        "new_cust_revenue": R.new_customer_revenue(cp), "exist_cust_growth": R.existing_customer_growth(cp),
        "lost_cust_revenue": R.attrition_revenue(cp), "new_customers": R.new_customers(cp),
        "lost_customers": R.lost_customers(cp)}
    n = 0
    for metric, df in singles.items():
        for r in df.collect():
            assert long[(r["year"], metric)] == float(r[metric])
            n += 1
    assert n == len(long) == 10
