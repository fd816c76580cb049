"""Independent DuckDB SQL for the retention keys.

Written a different way from the Spark plans on purpose: membership is
tested with correlated EXISTS / NOT EXISTS subqueries against the previous
observed period, the spine by scalar subqueries, not windows.  Views
``orders`` etc. are registered by the checker.
"""

CP = """
cp AS (
  SELECT o_custkey AS customer, CAST(year(o_orderdate) AS INTEGER) AS period,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue
  FROM orders GROUP BY 1, 2),
periods AS (SELECT DISTINCT period FROM cp),
spine AS (
  SELECT p.period,
         (SELECT max(q.period) FROM periods q WHERE q.period < p.period) AS prev_period,
         (SELECT min(q.period) FROM periods q WHERE q.period > p.period) AS next_period
  FROM periods p)"""

METRICS = CP + """,
tot AS (
  SELECT period, sum(revenue) AS net_revenue, count(customer) AS total_customers
  FROM cp GROUP BY period),
new_m AS (
  SELECT s.period, count(*) AS new_customers, sum(c.revenue) AS new_cust_revenue
  FROM spine s JOIN cp c ON c.period = s.period
  WHERE s.prev_period IS NOT NULL AND c.customer IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM cp d WHERE d.period = s.prev_period AND d.customer = c.customer)
  GROUP BY s.period),
ex_m AS (
  SELECT s.period, count(*) AS existing_customers, sum(c.revenue) AS cur_rev, sum(d.revenue) AS prev_rev
  FROM spine s JOIN cp c ON c.period = s.period
       JOIN cp d ON d.period = s.prev_period AND d.customer = c.customer
  GROUP BY s.period),
lost_m AS (
  SELECT s.period, count(*) AS lost_customers, sum(d.revenue) AS lost_cust_revenue
  FROM spine s JOIN cp d ON d.period = s.prev_period
  WHERE d.customer IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM cp c WHERE c.period = s.period AND c.customer = d.customer)
  GROUP BY s.period),
m AS (
  SELECT s.period, s.prev_period, t.net_revenue, t.total_customers,
         coalesce(n.new_customers, 0) AS new_customers,
         coalesce(n.new_cust_revenue, 0) AS new_cust_revenue,
         coalesce(e.cur_rev, 0) AS cur_rev, coalesce(e.prev_rev, 0) AS prev_rev,
         coalesce(l.lost_customers, 0) AS lost_customers,
         coalesce(l.lost_cust_revenue, 0) AS lost_cust_revenue
  FROM spine s JOIN tot t ON t.period = s.period
  LEFT JOIN new_m n ON n.period = s.period
  LEFT JOIN ex_m e ON e.period = s.period
  LEFT JOIN lost_m l ON l.period = s.period)"""


def _with(body: str, cte: str = METRICS) -> str:
    return "WITH " + cte.strip() + "\n" + body


SQL = {
    "retention_summary": _with("""
SELECT period AS year,
       CAST(net_revenue AS DOUBLE) AS net_revenue,
       CAST(new_cust_revenue AS DOUBLE) AS new_cust_revenue,
       CAST(cur_rev - prev_rev AS DOUBLE) AS exist_cust_growth,
       CAST(CASE WHEN prev_period IS NULL THEN net_revenue ELSE cur_rev END AS DOUBLE) AS current_revenue_exist_cust,
       CAST(prev_rev AS DOUBLE) AS prev_revenue_exist_cust,
       CAST(lost_cust_revenue AS DOUBLE) AS lost_cust_revenue,
       CAST(total_customers AS BIGINT) AS total_customers,
       CAST(new_customers AS BIGINT) AS new_customers,
       CAST(lost_customers AS BIGINT) AS lost_customers,
       CAST(total_customers - new_customers AS BIGINT) AS existing_cust
FROM m"""),
    "revenue_by_period": _with("""
SELECT period AS year, CAST(sum(revenue) AS DOUBLE) AS net_revenue FROM cp GROUP BY period""", CP),
    "new_customer_revenue": _with("""
SELECT period AS year, CAST(new_cust_revenue AS DOUBLE) AS new_cust_revenue FROM m WHERE prev_period IS NOT NULL"""),
    "existing_customer_growth": _with("""
SELECT period AS year, CAST(cur_rev - prev_rev AS DOUBLE) AS exist_cust_growth,
       CAST(cur_rev AS DOUBLE) AS current_revenue_exist_cust, CAST(prev_rev AS DOUBLE) AS prev_revenue_exist_cust
FROM m WHERE prev_period IS NOT NULL"""),
    "attrition_revenue": _with("""
SELECT period AS year, CAST(lost_cust_revenue AS DOUBLE) AS lost_cust_revenue FROM m WHERE prev_period IS NOT NULL"""),
    "existing_revenue_current": _with("""
SELECT period AS year, CAST(cur_rev AS DOUBLE) AS current_revenue_exist_cust FROM m WHERE prev_period IS NOT NULL"""),
    "existing_revenue_prior": _with("""
SELECT period AS year, CAST(prev_rev AS DOUBLE) AS prev_revenue_exist_cust FROM m WHERE prev_period IS NOT NULL"""),
    "customers_by_period": _with("""
SELECT period AS year, count(customer) AS total_customers FROM cp GROUP BY period""", CP),
    "customers_prev_period": _with("""
SELECT s.period AS year, s.prev_period AS prev_year, count(c.customer) AS prev_total_customers
FROM spine s JOIN cp c ON c.period = s.prev_period
GROUP BY s.period, s.prev_period""", CP),
    "new_customers": _with("""
SELECT period AS year, CAST(new_customers AS BIGINT) AS new_customers FROM m WHERE prev_period IS NOT NULL"""),
    "lost_customers": _with("""
SELECT period AS year, CAST(lost_customers AS BIGINT) AS lost_customers FROM m WHERE prev_period IS NOT NULL"""),
    "period_spine": _with("""
SELECT period, prev_period, next_period FROM spine""", CP),
    "customer_transitions": _with("""
SELECT c.customer, c.period AS year, CAST(c.revenue AS DOUBLE) AS revenue,
       CAST(d.revenue AS DOUBLE) AS prev_revenue,
       s.prev_period, s.next_period,
       (s.prev_period IS NOT NULL AND d.customer IS NULL) AS is_new,
       (d.customer IS NOT NULL) AS is_existing,
       (s.next_period IS NOT NULL AND NOT EXISTS
          (SELECT 1 FROM cp e WHERE e.period = s.next_period AND e.customer = c.customer)) AS is_lost_next
FROM cp c JOIN spine s ON s.period = c.period
LEFT JOIN cp d ON d.period = s.prev_period AND d.customer = c.customer
WHERE c.customer IS NOT NULL""", CP),
    "new_customers_anti": _with("""
SELECT c.customer, c.period AS year, CAST(c.revenue AS DOUBLE) AS revenue
FROM cp c JOIN spine s ON s.period = c.period
WHERE s.prev_period IS NOT NULL AND c.customer IS NOT NULL
  AND c.customer NOT IN (SELECT d.customer FROM cp d WHERE d.period = s.prev_period AND d.customer IS NOT NULL)""", CP),
    "existing_customers_semi": _with("""
SELECT c.customer, c.period AS year, CAST(c.revenue AS DOUBLE) AS revenue
FROM cp c JOIN spine s ON s.period = c.period
WHERE c.customer IN (SELECT d.customer FROM cp d WHERE d.period = s.prev_period)""", CP),
    "customers_except": _with("""
SELECT s.period AS year,
       (SELECT count(*) FROM (SELECT customer FROM cp WHERE period = s.period AND customer IS NOT NULL
                              EXCEPT SELECT customer FROM cp WHERE period = s.prev_period)) AS new_customers,
       (SELECT count(*) FROM (SELECT customer FROM cp WHERE period = s.prev_period AND customer IS NOT NULL
                              EXCEPT SELECT customer FROM cp WHERE period = s.period)) AS lost_customers
FROM spine s WHERE s.prev_period IS NOT NULL""", CP),
    "metrics_union": _with("""
SELECT period AS year, 'new_cust_revenue' AS metric, CAST(new_cust_revenue AS DOUBLE) AS value FROM m WHERE prev_period IS NOT NULL
UNION ALL SELECT period, 'exist_cust_growth', CAST(cur_rev - prev_rev AS DOUBLE) FROM m WHERE prev_period IS NOT NULL
UNION ALL SELECT period, 'lost_cust_revenue', CAST(lost_cust_revenue AS DOUBLE) FROM m WHERE prev_period IS NOT NULL
UNION ALL SELECT period, 'new_customers', CAST(new_customers AS DOUBLE) FROM m WHERE prev_period IS NOT NULL
UNION ALL SELECT period, 'lost_customers', CAST(lost_customers AS DOUBLE) FROM m WHERE prev_period IS NOT NULL"""),
    "revenue_sum_mean": _with("""
SELECT period AS year, CAST(sum(revenue) AS DOUBLE) AS net_revenue_sum,
       round(CAST(sum(revenue) AS DOUBLE) / count(revenue), 6) AS net_revenue_mean
FROM cp GROUP BY period""", CP),
    "distinct_customers": _with("""
SELECT count(DISTINCT period) AS n_periods, count(DISTINCT customer) AS n_customers FROM cp""", CP),
    "loyalty_distribution": _with("""
SELECT n_periods, count(*) AS n_customers,
       round(CAST(count(*) AS DOUBLE) * 100 / (SELECT count(DISTINCT customer) FROM cp), 6) AS pct_customers
FROM (SELECT customer, count(*) AS n_periods FROM cp WHERE customer IS NOT NULL GROUP BY customer)
GROUP BY n_periods""", CP),
    "revenue_rollup": _with("""
SELECT period AS year, CAST(sum(revenue) AS DOUBLE) AS net_revenue, false AS is_total FROM cp GROUP BY period
UNION ALL
SELECT NULL, CAST(sum(revenue) AS DOUBLE), true FROM cp""", CP),
}

# The same table from a fact bucketed by customer; counts of sketches, exact below 2^16 customers in two periods.
SQL["retention_bucketed"] = SQL["retention_summary"]
SQL["sketched_changes"] = _with("""
SELECT period AS year, CAST(total_customers AS BIGINT) AS total_customers, CAST(new_customers AS BIGINT) AS new_customers,
       CAST(lost_customers AS BIGINT) AS lost_customers, CAST(total_customers - new_customers AS BIGINT) AS existing_customers,
       CAST(0 AS DOUBLE) AS standard_error
FROM m WHERE prev_period IS NOT NULL""")
