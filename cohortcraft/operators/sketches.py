"""Counts of customers gained and lost between periods from stored sketches (E4, E19, O9, O10 at scale).

One theta sketch per period holds a bounded sample of the hashed customers
(about 2^lg_nominal entries).  Sketches are aggregated partially in the map
tasks, so no customer is shuffled: what moves is one sketch per (task,
period).  They can be stored, merged with those of new files, and subtracted
from each other, so a new period costs a pass over its own rows only.

Counts are exact while a union of two periods has fewer than 2^lg_nominal
customers.  Beyond that the standard error of each count is at most
|union| / sqrt(2^lg_nominal): columns ``*_error`` give it for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: log2 of the entries that a sketch keeps; 12 to 26.
LG_NOMINAL = 16


def period_sketches(fact: DataFrame, customer: str = "customer", period: str = "period", lg_nominal: int = LG_NOMINAL) -> DataFrame:
    """One row per period: ``period``, ``customers`` (theta sketch).

    ``fact`` may have any grain: repeated rows add nothing, NULL customers
    are not customers, rows without a period belong to none.
    """
    return (fact.filter(F.col(period).isNotNull()).groupBy(F.col(period).alias("period"))
            .agg(F.theta_sketch_agg(F.col(customer).cast("string"), lg_nominal).alias("customers")))


def merged(stored: DataFrame, new: DataFrame, lg_nominal: int = LG_NOMINAL) -> DataFrame:
    """Stored sketches extended by those of new files: the union of each period's sketches."""
    return stored.unionByName(new).groupBy("period").agg(F.theta_union_agg("customers", lg_nominal).alias("customers"))


def _count(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("bigint")


def estimated_changes(sketches: DataFrame, period_name: str = "year", lg_nominal: int = LG_NOMINAL) -> DataFrame:
    """Per observed period after the first: <period>, total, new, lost and existing customers, and their standard error.

    The window runs over one row per period, never over customers.
    """
    w = Window.orderBy("period")
    rows = sketches.select("period", "customers", F.lag("customers").over(w).alias("before")).filter(F.col("before").isNotNull())
    both = _count(F.theta_union("customers", "before", lg_nominal))
    exact = both < 2 ** lg_nominal
    return rows.select(
        F.col("period").alias(period_name), _count(F.col("customers")).alias("total_customers"),
        _count(F.theta_difference("customers", "before")).alias("new_customers"),
        _count(F.theta_difference("before", "customers")).alias("lost_customers"),
        _count(F.theta_intersection("customers", "before")).alias("existing_customers"),
        F.when(exact, 0.0).otherwise(F.ceil(both / (2 ** (lg_nominal / 2))).cast("double")).alias("standard_error"))
