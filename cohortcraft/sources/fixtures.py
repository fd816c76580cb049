"""Fact tables in the shapes the two analyses read.

``customer_period``: one row per (customer, period) with the period's
revenue, from any customer-by-period fact.  ``loan_like``: a wide
loans-shaped table derived from the driver's TPC-H-ish tables (rules in
FIXTURES.md), so that the loan analysis runs on data that grows with the
scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import bucket_hash
from .tables import test_table

MONEY = "decimal(18,2)"


def customer_period(df: DataFrame, customer: str | Column, period: str | Column,
                    value: str | Column) -> DataFrame:
    """Aggregate a fact to the (customer, period) grain: columns
    ``customer``, ``period``, ``revenue`` (DECIMAL, so sums do not depend on
    task order).

    The reference assumes its input is already unique per (customer, year);
    duplicates are summed here instead.  The aggregation is partial
    (map-side) before its shuffle, so a customer holding a large share of all
    rows is combined in every map task and leaves at most one row per
    (task, period): no skewed reducer forms.  NULL customers stay (their
    revenue belongs to the period total) and are ignored by the customer
    metrics.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return (df.select(as_col(customer).alias("customer"),
                      as_col(period).cast("int").alias("period"),
                      as_col(value).cast(MONEY).alias("value"))
              .groupBy("customer", "period")
              .agg(F.sum("value").alias("revenue")))


def customer_period_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for the retention input: orders by (o_custkey, year(o_orderdate))."""
    orders = test_table(spark, sf_dir, "orders")
    return customer_period(orders, "o_custkey", F.year("o_orderdate"), "o_totalprice")


def loan_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans-shaped table, one row per line item (FIXTURES.md §2).

    Join plan: lineitem with part (part key), orders (order key), customer
    (customer key) and nation.  The three big joins shuffle on their keys;
    nation and, at small scale, part and customer fall under AQE's measured
    broadcast threshold.  Only the columns used below are read from each
    scan.
    """
    li = test_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    # Only the probe side is spread over the cores; the other sides are
    # either broadcast (small) or shuffled for the join anyway.
    dim = lambda name: test_table(spark, sf_dir, name, min_partitions=1)
    pa = dim("part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    od = dim("orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate")
    cu = dim("customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    na = dim("nation").select("n_nationkey", "n_name")

    b = (li.join(pa, li.l_partkey == pa.p_partkey)
           .join(od, li.l_orderkey == od.o_orderkey)
           .join(cu, od.o_custkey == cu.c_custkey)
           .join(na, cu.c_nationkey == na.n_nationkey))
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in
                             ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    b = b.select(
        key.alias("loan_id"), bucket_hash(key).alias("h"),
        F.expr("cast(round(l_discount*100) as int) % 7").alias("g"),
        (F.col("l_linenumber") % 5 + 1).alias("sg"),
        "l_extendedprice", "l_tax", "l_quantity", "l_linenumber", "l_returnflag", "p_name", "p_size",
        "p_retailprice", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate",
        "c_mktsegment", "c_acctbal", "n_name")
    # Column rules of FIXTURES.md §2, written as SQL expressions so literal
    # typing (decimal literals, integer modulo) is the one stated there.
    return b.selectExpr(
        "loan_id",
        "h as split_bucket",
        "cast(5 + 3*g + 0.5*sg + 10*l_tax + case when l_quantity > 25 then 1.5 else 0 end"
        " + (h-50)*0.01 as double) as interest_rate",
        "substr('ABCDEFG', g+1, 1) as grade",
        "concat(substr('ABCDEFG', g+1, 1), cast(sg as string)) as sub_grade",
        "case when l_quantity > 25 then 60 else 36 end as term",
        "l_extendedprice as loan_amount",
        "n_name as state",
        "case when h % 13 <> 0 then p_name end as emp_title",
        "case when h % 17 <> 0 then p_size % 12 end as emp_length",
        "case l_returnflag when 'A' then 'MORTGAGE' when 'N' then 'RENT' else 'OWN' end as homeownership",
        "case when h = 0 then o_totalprice*10 else o_totalprice end as annual_income",
        "case when c_mktsegment in ('BUILDING','MACHINERY') then 'Not Verified'"
        " when c_mktsegment = 'FURNITURE' then 'Verified' else 'Source Verified' end as verified_income",
        "c_acctbal/100 as debt_to_income",
        "case when h % 7 = 0 then 'joint' else 'individual' end as application_type",
        "case when h % 7 = 0 then o_totalprice + p_retailprice end as annual_income_joint",
        "case when h % 7 = 0 and h % 2 = 0 then 'Verified' end as verification_income_joint",
        "case when h % 7 = 0 then c_acctbal/200 end as debt_to_income_joint",
        "case when h % 10 < 3 then l_linenumber*7 end as months_since_90d_late",
        "case when h % 10 < 5 then l_linenumber*5 end as months_since_last_delinq",
        "case when h % 8 <> 0 then l_linenumber-1 end as months_since_last_credit_inquiry",
        "p_size % 8 as open_credit_lines",
        "case when p_size % 8 = 0 then 0 else p_size % 8 - cast(h % 2 as int) end as num_satisfactory_accounts",
        "case when h % 20 = 0 then 1 else 0 end as delinq_2y",
        "case when h % 25 = 0 then 1 else 0 end as num_collections_last_12m",
        "case when h % 50 = 0 then 1 else 0 end as tax_liens",
        "o_orderpriority as loan_purpose",
        "o_orderstatus as loan_status",
        "l_extendedprice / case when l_quantity > 25 then 60 else 36 end as installment",
        "cast(month(o_orderdate) as int) as issue_month",
    )
