"""Customer retention between consecutive observed periods (F1, F2, D1-D3,
H1-H3, E1-E4, E7, E21, O1-O11).

Input is a ``customer_period`` frame (``customer``, ``period``, ``revenue``),
one row per (customer, period), as built by
``cohortcraft.sources.customer_period``.

Plan shape of every metric (``summary`` in particular):

1. ``customer_period``: partial aggregate -> exchange on (customer, period)
   -> final aggregate.  A customer with a huge share of the raw rows is
   combined map-side, so no reducer sees more than (map tasks x periods)
   rows of it.
2. ``lag``/``lead`` over ``partitionBy(customer).orderBy(period)``: one
   exchange on customer; after step 1 a customer has at most one row per
   period, so no window partition is large.
3. The per-row result is grouped by (period, lag_period, lead_period) with a
   partial aggregate: at most P^3 groups for P periods, whatever the number
   of customers.  All classification against the *observed* period spine,
   the period totals and the spine itself come from that tiny table, so the
   big rows are scanned once and never joined.

"Previous" is the previous *observed* period and "next" the next observed
one (a returner after a gap period is new again; a customer who skips the
next observed period is lost in it).  The first period has no previous
period; the last has no next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY_OUT = "double"


def _money(c):
    """Decimal sums are exact; only the finished value is turned into DOUBLE."""
    return c.cast(MONEY_OUT)


def _known(cp: DataFrame) -> DataFrame:
    # NULL customers carry revenue into period totals but are not customers:
    # drop them before any per-customer window (they would form one huge
    # window partition).
    return cp.filter(F.col("customer").isNotNull())


def by_period(cp: DataFrame) -> DataFrame:
    """One row per observed period: ``period``, ``net_revenue`` (DECIMAL),
    ``total_customers``, ``n_rows``."""
    return cp.groupBy("period").agg(
        F.sum("revenue").alias("net_revenue"),
        F.count("customer").alias("total_customers"),
        F.count(F.lit(1)).alias("n_rows"))


def period_spine(cp: DataFrame) -> DataFrame:
    """A3: observed periods with the previous and next observed period.

    The window has no partition key on purpose: it runs over the distinct
    periods only (one row per period), never over customer rows.
    """
    w = Window.orderBy("period")
    return (cp.select("period").distinct()
              .select("period",
                      F.lag("period").over(w).alias("prev_period"),
                      F.lead("period").over(w).alias("next_period")))


def _with_spine(rows: DataFrame, cp: DataFrame) -> DataFrame:
    """``rows`` with the previous and next observed period of their period.

    The ordered periods are one array (a scalar subquery over the distinct
    periods), so the rows are neither joined nor shuffled on ``period``.
    """
    periods = cp.agg(F.sort_array(F.collect_set("period")).alias("periods")).scalar()
    at = F.array_position(periods, F.col("period")).cast("int")
    return rows.filter(F.col("period").isNotNull()).withColumns(
        {"prev_period": F.get(periods, at - 2), "next_period": F.get(periods, at)})


def _customer_steps(cp: DataFrame) -> DataFrame:
    """Per (customer, period): the customer's own previous and next period
    and previous revenue (F1 core; one exchange on customer)."""
    w = Window.partitionBy("customer").orderBy("period")
    return _known(cp).select(
        "customer", "period", "revenue",
        F.lag("period").over(w).alias("lag_period"),
        F.lag("revenue").over(w).alias("lag_revenue"),
        F.lead("period").over(w).alias("lead_period"))


def _flags(df: DataFrame) -> DataFrame:
    """Classify rows that carry lag/lead of the customer and prev/next of the spine."""
    existing = F.coalesce(F.col("lag_period") == F.col("prev_period"), F.lit(False))
    return (df.withColumn("is_existing", existing)
              .withColumn("is_new", F.col("prev_period").isNotNull() & ~F.col("is_existing"))
              .withColumn("is_lost_next", F.col("next_period").isNotNull()
                          & ~F.coalesce(F.col("lead_period") == F.col("next_period"), F.lit(False))))


def transitions(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """every (customer, period) row with its retention flags.

    Columns: customer, <period>, revenue, prev_revenue (the customer's
    revenue in the previous observed period when it is an existing
    customer), prev_period, next_period, is_new, is_existing, is_lost_next.
    """
    t = _flags(_with_spine(_customer_steps(cp), cp))
    return t.select(
        "customer", F.col("period").alias(period_name),
        _money(F.col("revenue")).alias("revenue"),
        _money(F.when(F.col("is_existing"), F.col("lag_revenue"))).alias("prev_revenue"),
        "prev_period", "next_period", "is_new", "is_existing", "is_lost_next")


def _step_table(cp: DataFrame) -> DataFrame:
    """The only pass over customer rows that the period metrics need:
    lag/lead per customer, then rows reduced to (period, lag_period,
    lead_period, known) groups with their count and revenue sums - at most
    2 x P^3 rows whatever the number of customers.

    NULL customers stay in this pass (``known`` = false): after the grain
    aggregation they are one row per period, i.e. one window partition of at
    most P rows, so keeping them costs nothing and lets the period totals
    come from the same table instead of a second scan.
    """
    w = Window.partitionBy("customer").orderBy("period")
    steps = cp.select(
        "period", "revenue", F.col("customer").isNotNull().alias("known"),
        F.lag("period").over(w).alias("lag_period"),
        F.lag("revenue").over(w).alias("lag_revenue"),
        F.lead("period").over(w).alias("lead_period"))
    return (steps.groupBy("period", "lag_period", "lead_period", "known")
                 .agg(F.count(F.lit(1)).alias("n"),
                      F.sum("revenue").alias("rev"),
                      F.sum("lag_revenue").alias("lag_rev")))


def _assembled(cp: DataFrame) -> DataFrame:
    """Every period metric from the step table in one chain, no joins.

    The step table is the matrix of transitions between periods; each of its
    rows finds the previous and next *observed* period by its period's place
    in the array of all periods (a scalar subquery over the same table, whose exchange is reused), so its
    up to 2 x P^3 rows stay where they are: no window over them, nothing in
    one task but the P periods.  Each row then emits two
    records: one labelled with its own period (totals, new and existing
    customers) and one labelled with the next observed period (customers
    lost there); a single ``groupBy(label)`` adds them up.  The period's own
    previous period travels along as ``label_prev`` (for the record labelled
    with the next period it is the row's own period).
    """
    steps = _step_table(cp)
    t = _flags(_with_spine(steps, steps))
    money = "decimal(38,2)"
    none_m = F.lit(None).cast(money)
    zero_n = F.lit(0).cast("bigint")
    known, n, rev = F.col("known"), F.col("n").cast("bigint"), F.col("rev").cast(money)
    new, ex, lost = known & F.col("is_new"), known & F.col("is_existing"), known & F.col("is_lost_next")
    cur = F.struct(F.col("period").alias("label"), F.col("prev_period").alias("label_prev"),
                   rev.alias("net_revenue"), F.when(known, n).otherwise(zero_n).alias("total_customers"),
                   F.when(new, n).otherwise(zero_n).alias("new_customers"),
                   F.when(new, rev).otherwise(none_m).alias("new_cust_revenue"),
                   F.when(ex, n).otherwise(zero_n).alias("existing_customers"),
                   F.when(ex, rev).otherwise(none_m).alias("current_revenue_exist_cust"),
                   F.when(ex, F.col("lag_rev").cast(money)).otherwise(none_m).alias("prev_revenue_exist_cust"),
                   zero_n.alias("lost_customers"), none_m.alias("lost_cust_revenue"))
    nxt = F.struct(F.col("next_period").alias("label"), F.col("period").alias("label_prev"),
                   none_m.alias("net_revenue"), zero_n.alias("total_customers"), zero_n.alias("new_customers"),
                   none_m.alias("new_cust_revenue"), zero_n.alias("existing_customers"),
                   none_m.alias("current_revenue_exist_cust"), none_m.alias("prev_revenue_exist_cust"),
                   F.when(lost, n).otherwise(zero_n).alias("lost_customers"),
                   F.when(lost, rev).otherwise(none_m).alias("lost_cust_revenue"))
    rows = t.select(F.inline(F.array(cur, nxt))).filter(F.col("label").isNotNull())
    zero_m = F.lit(0).cast(money)
    summed = lambda c: F.coalesce(F.sum(c), zero_m).alias(c)
    counted = lambda c: F.sum(c).cast("bigint").alias(c)
    return rows.groupBy(F.col("label").alias("period")).agg(
        F.max("label_prev").alias("prev_period"),
        F.sum("net_revenue").alias("net_revenue"),
        counted("total_customers"), counted("new_customers"), summed("new_cust_revenue"),
        counted("existing_customers"), summed("current_revenue_exist_cust"),
        summed("prev_revenue_exist_cust"), counted("lost_customers"), summed("lost_cust_revenue"))


SUMMARY_COLUMNS = ["net_revenue", "new_cust_revenue", "exist_cust_growth",
                   "current_revenue_exist_cust", "prev_revenue_exist_cust", "lost_cust_revenue",
                   "total_customers", "new_customers", "lost_customers", "existing_cust"]


def summary(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """The yearly retention table.

    Every observed period gets a row; missing metrics are 0.  In the first
    period the existing-customer revenue is the total revenue and every
    customer counts as existing (total - new, new = 0), as in the reference.
    """
    a = _assembled(cp)
    first = F.col("prev_period").isNull()
    growth = F.col("current_revenue_exist_cust") - F.col("prev_revenue_exist_cust")
    return a.select(
        F.col("period").alias(period_name),
        _money(F.col("net_revenue")).alias("net_revenue"),
        _money(F.col("new_cust_revenue")).alias("new_cust_revenue"),
        _money(growth).alias("exist_cust_growth"),
        _money(F.when(first, F.col("net_revenue"))
                .otherwise(F.col("current_revenue_exist_cust"))).alias("current_revenue_exist_cust"),
        _money(F.col("prev_revenue_exist_cust")).alias("prev_revenue_exist_cust"),
        _money(F.col("lost_cust_revenue")).alias("lost_cust_revenue"),
        F.col("total_customers").cast("bigint").alias("total_customers"),
        F.col("new_customers"),
        F.col("lost_customers"),
        (F.col("total_customers") - F.col("new_customers")).cast("bigint").alias("existing_cust"))


def _later_periods(cp: DataFrame) -> DataFrame:
    """Metric rows of every period that has a previous observed period
    (the reference's ``for i in range(1, ...)`` loops)."""
    return _assembled(cp).filter(F.col("prev_period").isNotNull())


# --- O1-O10, one function each -------------------------------------------

def revenue_by_period(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """Total revenue per period (NULL customers included)."""
    return cp.groupBy(F.col("period").alias(period_name)).agg(
        _money(F.sum("revenue")).alias("net_revenue"))


def new_customer_revenue(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """O2: revenue of customers absent from the previous observed period."""
    return _later_periods(cp).select(F.col("period").alias(period_name),
                                     _money(F.col("new_cust_revenue")).alias("new_cust_revenue"))


def existing_customer_growth(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """O3: current minus prior revenue of customers present in both periods."""
    return _later_periods(cp).select(
        F.col("period").alias(period_name),
        _money(F.col("current_revenue_exist_cust") - F.col("prev_revenue_exist_cust")).alias("exist_cust_growth"),
        _money(F.col("current_revenue_exist_cust")).alias("current_revenue_exist_cust"),
        _money(F.col("prev_revenue_exist_cust")).alias("prev_revenue_exist_cust"))


def attrition_revenue(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """Previous-period revenue of customers missing in the period."""
    return _later_periods(cp).select(F.col("period").alias(period_name),
                                     _money(F.col("lost_cust_revenue")).alias("lost_cust_revenue"))


def existing_revenue_current(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """Current revenue of existing customers."""
    return _later_periods(cp).select(F.col("period").alias(period_name),
                                     _money(F.col("current_revenue_exist_cust")).alias("current_revenue_exist_cust"))


def existing_revenue_prior(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """The same customers' revenue in the previous observed period."""
    return _later_periods(cp).select(F.col("period").alias(period_name),
                                     _money(F.col("prev_revenue_exist_cust")).alias("prev_revenue_exist_cust"))


def customers_by_period(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """Customers per period (non-NULL customer rows)."""
    return cp.groupBy(F.col("period").alias(period_name)).agg(
        F.count("customer").alias("total_customers"))


def customers_prev_period(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """Customers of the previous observed period, by ``lag`` over
    the one-row-per-period table."""
    w = Window.orderBy("period")
    t = by_period(cp).select("period", "total_customers",
                             F.lag("period").over(w).alias("prev_period"),
                             F.lag("total_customers").over(w).alias("prev_total_customers"))
    return t.filter(F.col("prev_period").isNotNull()).select(
        F.col("period").alias(period_name), F.col("prev_period").alias(f"prev_{period_name}"),
        F.col("prev_total_customers").cast("bigint").alias("prev_total_customers"))


def new_customers(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """Number of customers absent from the previous observed period."""
    return _later_periods(cp).select(F.col("period").alias(period_name), "new_customers")


def lost_customers(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """Customers of the previous observed period missing in this one."""
    return _later_periods(cp).select(F.col("period").alias(period_name), "lost_customers")


# --- joins and set operations (D2, D3, H1, H2) ----------------------------

def _with_prev(cp: DataFrame) -> DataFrame:
    return _with_spine(_known(cp), cp)


def new_by_anti_join(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """Rows of customers new in their period, by ``left_anti`` against
    the previous observed period's customers.  Both sides are keyed by
    (customer, period); the right side keeps the partitioning of the
    ``customer_period`` aggregate, only the left side is re-shuffled."""
    cur = _with_prev(cp).filter(F.col("prev_period").isNotNull())
    prev = _known(cp).select("customer", F.col("period").alias("prev_period"))
    return (cur.join(prev, ["customer", "prev_period"], "left_anti")
               .select("customer", F.col("period").alias(period_name),
                       _money(F.col("revenue")).alias("revenue")))


def existing_by_semi_join(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """D3: rows of customers also present in the previous observed period
    (``left_semi``)."""
    cur = _with_prev(cp).filter(F.col("prev_period").isNotNull())
    prev = _known(cp).select("customer", F.col("period").alias("prev_period"))
    return (cur.join(prev, ["customer", "prev_period"], "left_semi")
               .select("customer", F.col("period").alias(period_name),
                       _money(F.col("revenue")).alias("revenue")))


def except_counts(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """|cur - prev| and |prev - cur| per period via EXCEPT
    (``subtract``) of customer key sets; an independent route to O9/O10."""
    sp = _with_prev(cp)
    cur_keys = sp.filter(F.col("prev_period").isNotNull()).select(
        "customer", F.col("prev_period").alias("a"), F.col("period").alias("b"))
    prev_keys = sp.filter(F.col("next_period").isNotNull()).select(
        "customer", F.col("period").alias("a"), F.col("next_period").alias("b"))
    new = cur_keys.subtract(prev_keys).groupBy("b").agg(F.count(F.lit(1)).alias("new_customers"))
    lost = prev_keys.subtract(cur_keys).groupBy("b").agg(F.count(F.lit(1)).alias("lost_customers"))
    later = period_spine(cp).filter(F.col("prev_period").isNotNull()).select(F.col("period").alias("b"))
    return (later.join(new, "b", "left").join(lost, "b", "left")
                 .select(F.col("b").alias(period_name),
                         F.coalesce("new_customers", F.lit(0)).cast("bigint").alias("new_customers"),
                         F.coalesce("lost_customers", F.lit(0)).cast("bigint").alias("lost_customers")))


def metrics_long(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """H2: the per-period metric tables appended into one long table:
    <period>, metric, value.  The reference appends one frame per metric;
    here all five come from one pass and are unpivoted with ``inline``."""
    a = _later_periods(cp)
    metric = lambda name, c: F.struct(F.lit(name).alias("metric"), c.cast("double").alias("value"))
    return a.select(F.col("period").alias(period_name), F.inline(F.array(
        metric("new_cust_revenue", F.col("new_cust_revenue")),
        metric("exist_cust_growth", F.col("current_revenue_exist_cust") - F.col("prev_revenue_exist_cust")),
        metric("lost_cust_revenue", F.col("lost_cust_revenue")),
        metric("new_customers", F.col("new_customers")),
        metric("lost_customers", F.col("lost_customers")))))


# --- profile-style aggregates of the retention fact (E2, E4, E7, E21) -----

def revenue_sum_mean(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """Sum and mean of revenue per period (flattened names)."""
    return cp.groupBy(F.col("period").alias(period_name)).agg(
        _money(F.sum("revenue")).alias("net_revenue_sum"),
        F.round(F.sum("revenue").cast("double") / F.count("revenue"), 6).alias("net_revenue_mean"))


def distinct_counts(cp: DataFrame) -> DataFrame:
    """Number of distinct periods and distinct customers (exact;
    ``approx_count_distinct`` is the choice when only an estimate is needed
    at very large cardinality)."""
    return cp.agg(F.count_distinct("period").alias("n_periods"),
                  F.count_distinct("customer").alias("n_customers"))


def loyalty(cp: DataFrame) -> DataFrame:
    """Frequency of frequencies - periods per customer, then the share
    of customers (percent) with each count.  The second aggregation runs on
    at most P rows."""
    per_cust = _known(cp).groupBy("customer").agg(F.count(F.lit(1)).alias("n_periods"))
    dist = per_cust.groupBy("n_periods").agg(F.count(F.lit(1)).alias("n_customers"))
    return dist.select(
        "n_periods", "n_customers",
        F.round(F.col("n_customers").cast("double") * 100 / F.sum("n_customers").over(Window.partitionBy()), 6)
         .alias("pct_customers"))


def revenue_rollup(cp: DataFrame, period_name: str = "year") -> DataFrame:
    """Revenue per period plus a grand-total row (``rollup``)."""
    return cp.withColumnRenamed("period", period_name).rollup(period_name).agg(
        _money(F.sum("revenue")).alias("net_revenue"),
        (F.grouping(period_name) == 1).alias("is_total"))
