"""Independent DuckDB SQL for the loan-analysis and orders-profile keys.

The loan fixture is the SQL of FIXTURES.md §2; every later stage is
written as plain SQL (CASE, subqueries, UNPIVOT, window ranks) over it.
Column lists are the fixture's schema.
"""

LOAN_LIKE = """
b AS (
 SELECT concat(l_orderkey,'-',l_partkey,'-',l_suppkey,'-',l_linenumber) AS loan_id,
        CAST('0x'||substr(md5(concat(l_orderkey,'-',l_partkey,'-',l_suppkey,'-',l_linenumber)),1,8) AS BIGINT) % 100 AS h,
        CAST(round(l_discount*100) AS INTEGER) % 7 AS g, l_linenumber % 5 + 1 AS sg,
        l_extendedprice, l_tax, l_quantity, l_linenumber, l_returnflag, p_name, p_size, p_retailprice,
        o_totalprice, o_orderpriority, o_orderstatus, o_orderdate, c_mktsegment, c_acctbal, n_name
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
raw AS (
 SELECT loan_id, h AS split_bucket,
 CAST(5 + 3*g + 0.5*sg + 10*l_tax + CASE WHEN l_quantity > 25 THEN 1.5 ELSE 0 END + (h-50)*0.01 AS DOUBLE) AS interest_rate,
 substr('ABCDEFG', g+1, 1) AS grade, concat(substr('ABCDEFG', g+1, 1), sg) AS sub_grade,
 CASE WHEN l_quantity > 25 THEN 60 ELSE 36 END AS term, l_extendedprice AS loan_amount,
 n_name AS state, CASE WHEN h%13 <> 0 THEN p_name END AS emp_title,
 CASE WHEN h%17 <> 0 THEN p_size % 12 END AS emp_length,
 CASE l_returnflag WHEN 'A' THEN 'MORTGAGE' WHEN 'N' THEN 'RENT' ELSE 'OWN' END AS homeownership,
 CASE WHEN h = 0 THEN o_totalprice*10 ELSE o_totalprice END AS annual_income,
 CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'Not Verified'
      WHEN c_mktsegment = 'FURNITURE' THEN 'Verified' ELSE 'Source Verified' END AS verified_income,
 c_acctbal/100 AS debt_to_income,
 CASE WHEN h%7 = 0 THEN 'joint' ELSE 'individual' END AS application_type,
 CASE WHEN h%7 = 0 THEN o_totalprice + p_retailprice END AS annual_income_joint,
 CASE WHEN h%7 = 0 AND h%2 = 0 THEN 'Verified' END AS verification_income_joint,
 CASE WHEN h%7 = 0 THEN c_acctbal/200 END AS debt_to_income_joint,
 CASE WHEN h%10 < 3 THEN l_linenumber*7 END AS months_since_90d_late,
 CASE WHEN h%10 < 5 THEN l_linenumber*5 END AS months_since_last_delinq,
 CASE WHEN h%8 <> 0 THEN l_linenumber-1 END AS months_since_last_credit_inquiry,
 p_size % 8 AS open_credit_lines,
 CASE WHEN p_size%8 = 0 THEN 0 ELSE p_size%8 - CAST(h%2 AS INTEGER) END AS num_satisfactory_accounts,
 CASE WHEN h%20 = 0 THEN 1 ELSE 0 END AS delinq_2y,
 CASE WHEN h%25 = 0 THEN 1 ELSE 0 END AS num_collections_last_12m,
 CASE WHEN h%50 = 0 THEN 1 ELSE 0 END AS tax_liens,
 o_orderpriority AS loan_purpose, o_orderstatus AS loan_status,
 l_extendedprice / CASE WHEN l_quantity > 25 THEN 60 ELSE 36 END AS installment,
 CAST(month(o_orderdate) AS INTEGER) AS issue_month
 FROM b)"""

# after leakage / issue_month drop, tenure flag and the income cut
OUTL = """,
outl AS (
 SELECT * EXCLUDE (installment, loan_status, issue_month, emp_length),
        CASE WHEN emp_length >= 10 THEN 1 ELSE 0 END AS emp_length1
 FROM raw WHERE annual_income <= 1500000)"""

# mostly-zero columns dropped, joint applications merged
S1 = OUTL + """,
s1 AS (
 SELECT * EXCLUDE (delinq_2y, num_collections_last_12m, tax_liens, application_type,
                   annual_income_joint, verification_income_joint, debt_to_income_joint,
                   annual_income, verified_income, debt_to_income),
        CASE WHEN application_type = 'individual' THEN annual_income ELSE annual_income_joint END AS annual_income,
        CASE WHEN application_type = 'individual' THEN verified_income ELSE verification_income_joint END AS verified_income,
        CASE WHEN application_type = 'individual' THEN debt_to_income ELSE debt_to_income_joint END AS debt_to_income
 FROM outl)"""

MODES = """,
modes AS (
 SELECT (SELECT months_since_last_credit_inquiry FROM s1 WHERE months_since_last_credit_inquiry IS NOT NULL
         GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS m_inq,
        (SELECT verified_income FROM s1 WHERE verified_income IS NOT NULL
         GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS m_ver)"""

S2 = S1 + MODES + """,
s2 AS (
 SELECT s1.* REPLACE (coalesce(months_since_90d_late, 0) AS months_since_90d_late,
                      coalesce(months_since_last_delinq, 0) AS months_since_last_delinq,
                      coalesce(months_since_last_credit_inquiry, m_inq) AS months_since_last_credit_inquiry,
                      coalesce(verified_income, m_ver) AS verified_income,
                      coalesce(emp_title, 'other') AS emp_title)
 FROM s1, modes)"""

S3 = S2 + """,
s3 AS (
 SELECT *, coalesce(CAST(num_satisfactory_accounts AS DOUBLE) / nullif(open_credit_lines, 0), 0) AS satis_pr_cred_lines,
        CAST('0x'||substr(md5(loan_id),1,8) AS BIGINT) % 100 < 20 AS is_test
 FROM s2)"""

NUMS = ["term", "loan_amount", "months_since_90d_late", "months_since_last_delinq",
        "months_since_last_credit_inquiry", "open_credit_lines", "num_satisfactory_accounts",
        "emp_length1", "annual_income", "debt_to_income", "satis_pr_cred_lines"]
CATS = ["grade", "sub_grade", "state", "emp_title", "homeownership", "loan_purpose", "verified_income"]
CLEAN_NUMS = ["interest_rate", "term", "loan_amount", "months_since_90d_late", "months_since_last_delinq",
              "months_since_last_credit_inquiry", "open_credit_lines", "num_satisfactory_accounts",
              "emp_length1", "annual_income", "debt_to_income"]

STD = S3 + """,
st AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMS) + """
       FROM s3 WHERE NOT is_test),
std AS (SELECT s3.* REPLACE (""" + ", ".join(
    f"(CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in NUMS) + """)
        FROM s3, st)"""

TOPS = """,
cat_counts AS (
 SELECT column_name, value, count(*) AS n
 FROM (UNPIVOT (SELECT """ + ", ".join(CATS) + """ FROM s3 WHERE NOT is_test)
       ON """ + ", ".join(CATS) + """ INTO NAME column_name VALUE value)
 GROUP BY 1, 2),
tops AS (
 SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rk
 FROM cat_counts)"""

# Row-wise from here on (the key is not unique at every scale): each stage
# replaces columns of the previous one instead of joining on the key.
SHRUNK = STD + TOPS + """,
shr AS (
 SELECT std.* REPLACE (""" + ", ".join(
    f"CASE WHEN {c} IN (SELECT value FROM tops WHERE column_name = '{c}' AND rk <= 15) THEN {c} ELSE 'other' END AS {c}"
    for c in CATS) + """)
 FROM std)"""

ENC = SHRUNK + """,
labels AS (
 SELECT DISTINCT column_name, value
 FROM (UNPIVOT (SELECT """ + ", ".join(CATS) + """ FROM shr WHERE NOT is_test)
       ON """ + ", ".join(CATS) + """ INTO NAME column_name VALUE value)),
enc AS (
 SELECT shr.* REPLACE (""" + ", ".join(
    f"CAST(CASE WHEN {c} IN (SELECT value FROM labels WHERE column_name = '{c}') "
    f"THEN (SELECT count(*) FROM labels WHERE column_name = '{c}' AND value < shr.{c}) "
    f"ELSE (SELECT count(*) FROM labels WHERE column_name = '{c}') END AS INTEGER) AS {c}"
    for c in CATS) + """)
 FROM shr)"""


def _w(cte: str, body: str) -> str:
    return "WITH " + LOAN_LIKE.strip() + cte + "\n" + body


def _r(c: str) -> str:
    return f"round(CAST({c} AS DOUBLE), 6)"


RAW_COLUMNS = ["loan_id", "split_bucket", "interest_rate", "grade", "sub_grade", "term", "loan_amount", "state",
               "emp_title", "emp_length", "homeownership", "annual_income", "verified_income", "debt_to_income",
               "application_type", "annual_income_joint", "verification_income_joint", "debt_to_income_joint",
               "months_since_90d_late", "months_since_last_delinq", "months_since_last_credit_inquiry",
               "open_credit_lines", "num_satisfactory_accounts", "delinq_2y", "num_collections_last_12m",
               "tax_liens", "loan_purpose", "loan_status", "installment", "issue_month"]
FAMILY = """CASE WHEN t IN ('BIGINT','INTEGER','SMALLINT','TINYINT','HUGEINT') THEN 'integer'
 WHEN t IN ('DOUBLE','FLOAT') OR t LIKE 'DECIMAL%' THEN 'float' WHEN t = 'VARCHAR' THEN 'text'
 WHEN t LIKE 'TIMESTAMP%' OR t = 'DATE' THEN 'timestamp' WHEN t = 'BOOLEAN' THEN 'boolean' ELSE 'other' END"""

INSPECT = "loan_id, annual_income, verified_income, emp_title"

SQL = {
    "table_profile": _w("", "SELECT column_name, ordinal, " + FAMILY + " AS dtype_family, n_rows, n_non_null FROM (" +
                        "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i + 1} AS ordinal, typeof(any_value({c})) AS t, "
        f"count(*) AS n_rows, count({c}) AS n_non_null FROM raw" for i, c in enumerate(RAW_COLUMNS)) + ")"),
    "value_counts": _w("", """
SELECT 'state' AS column_name, state AS value, count(*) AS n FROM raw WHERE state IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'issue_month', CAST(issue_month AS VARCHAR), count(*) FROM raw WHERE issue_month IS NOT NULL GROUP BY 2"""),
    "value_shares": _w("", """
SELECT column_name, value, n, round(CAST(n AS DOUBLE) * 100 / sum(n) OVER (PARTITION BY column_name), 6) AS pct
FROM (SELECT 'emp_length' AS column_name, CAST(emp_length AS VARCHAR) AS value, count(*) AS n
      FROM raw WHERE emp_length IS NOT NULL GROUP BY 2
      UNION ALL
      SELECT 'homeownership', homeownership, count(*) FROM raw WHERE homeownership IS NOT NULL GROUP BY 2)"""),
    "binarize_tenure": _w("", """
SELECT loan_id, emp_length, CASE WHEN emp_length >= 10 THEN 1 ELSE 0 END AS emp_length1 FROM raw"""),
    "unverified_top_income": _w("", """
SELECT """ + INSPECT + """ FROM raw
WHERE annual_income > (SELECT quantile_cont(annual_income, 0.75)
                              + 1.5 * (quantile_cont(annual_income, 0.75) - quantile_cont(annual_income, 0.25)) FROM raw)
  AND verified_income = 'Not Verified'
ORDER BY annual_income DESC, loan_id LIMIT 5"""),
    "extreme_income": _w("", """
SELECT """ + INSPECT + """ FROM raw WHERE annual_income > 1500000 ORDER BY annual_income DESC, loan_id LIMIT 5"""),
    "remove_outliers": _w("", """
SELECT loan_id, annual_income FROM raw WHERE annual_income <= 1500000"""),
    "drop_mostly_zero": _w(OUTL, """
SELECT column_name, zero_pct, zero_pct >= 90 AS dropped FROM (
 SELECT 'delinq_2y' AS column_name, round(CAST(count_if(delinq_2y = 0) AS DOUBLE) * 100 / count(*), 6) AS zero_pct FROM outl
 UNION ALL SELECT 'num_collections_last_12m', round(CAST(count_if(num_collections_last_12m = 0) AS DOUBLE) * 100 / count(*), 6) FROM outl
 UNION ALL SELECT 'tax_liens', round(CAST(count_if(tax_liens = 0) AS DOUBLE) * 100 / count(*), 6) FROM outl)"""),
    "zero_share": _w(OUTL, """
SELECT column_name, round(z, 6) AS zero_pct, round(100 - z, 6) AS nonzero_pct FROM (
 SELECT 'delinq_2y' AS column_name, CAST(count_if(delinq_2y = 0) AS DOUBLE) * 100 / count(*) AS z FROM outl
 UNION ALL SELECT 'num_collections_last_12m', CAST(count_if(num_collections_last_12m = 0) AS DOUBLE) * 100 / count(*) FROM outl
 UNION ALL SELECT 'tax_liens', CAST(count_if(tax_liens = 0) AS DOUBLE) * 100 / count(*) FROM outl)"""),
    "resolve_joint": _w("", """
SELECT loan_id,
       CASE WHEN application_type = 'individual' THEN annual_income ELSE annual_income_joint END AS annual_income,
       CASE WHEN application_type = 'individual' THEN verified_income ELSE verification_income_joint END AS verified_income,
       CASE WHEN application_type = 'individual' THEN debt_to_income ELSE debt_to_income_joint END AS debt_to_income
FROM raw"""),
    "missing_report": _w(S1, """
SELECT column_name, CAST(n_missing AS BIGINT) AS n_missing,
       round(CAST(n_missing AS DOUBLE) * 100 / (SELECT count(*) FROM s1), 6) AS pct_missing,
       CAST(row_number() OVER (ORDER BY n_missing DESC, column_name) AS INTEGER) AS rank
FROM (UNPIVOT (SELECT """ + ", ".join(f"count_if({c} IS NULL) AS {c}" for c in [
        "loan_id", "split_bucket", "interest_rate", "grade", "sub_grade", "term", "loan_amount", "state",
        "emp_title", "homeownership", "annual_income", "verified_income", "debt_to_income",
        "months_since_90d_late", "months_since_last_delinq", "months_since_last_credit_inquiry",
        "open_credit_lines", "num_satisfactory_accounts", "loan_purpose", "emp_length1"]) + """ FROM s1)
      ON COLUMNS(*) INTO NAME column_name VALUE n_missing)
WHERE n_missing > 0"""),
    "zero_counts": _w(S1, """
SELECT 'months_since_90d_late' AS column_name, CAST(count_if(months_since_90d_late = 0) AS BIGINT) AS n_zero FROM s1
UNION ALL SELECT 'months_since_last_delinq', CAST(count_if(months_since_last_delinq = 0) AS BIGINT) FROM s1
UNION ALL SELECT 'months_since_last_credit_inquiry', CAST(count_if(months_since_last_credit_inquiry = 0) AS BIGINT) FROM s1"""),
    "mode_values": _w(S1 + MODES, """
SELECT 'months_since_last_credit_inquiry' AS column_name, CAST(m_inq AS VARCHAR) AS mode FROM modes
UNION ALL SELECT 'verified_income', m_ver FROM modes"""),
    "impute_constant": _w(S1, """
SELECT loan_id, coalesce(months_since_90d_late, 0) AS months_since_90d_late,
       coalesce(months_since_last_delinq, 0) AS months_since_last_delinq,
       coalesce(emp_title, 'other') AS emp_title FROM s1"""),
    "impute_mode": _w(S2, """
SELECT loan_id, months_since_last_credit_inquiry, verified_income FROM s2"""),
    "completeness_gate": _w(S2, """
SELECT n = 0 AS complete, CAST(n AS BIGINT) AS n_columns_missing FROM (
 SELECT """ + " + ".join(f"max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in [
        "loan_id", "split_bucket", "interest_rate", "grade", "sub_grade", "term", "loan_amount", "state",
        "emp_title", "homeownership", "annual_income", "verified_income", "debt_to_income",
        "months_since_90d_late", "months_since_last_delinq", "months_since_last_credit_inquiry",
        "open_credit_lines", "num_satisfactory_accounts", "loan_purpose", "emp_length1"]) + """ AS n FROM s2)"""),
    "ratio_feature": _w("", """
SELECT loan_id, coalesce(CAST(num_satisfactory_accounts AS DOUBLE) / nullif(open_credit_lines, 0), 0) AS satis_pr_cred_lines
FROM raw"""),
    "describe_text": _w(S2, """
SELECT column_name, CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
       arg_min(value, struct_pack(a := -n, b := value)) AS top, max(n) AS freq
FROM (SELECT column_name, value, count(*) AS n
      FROM (UNPIVOT (SELECT """ + ", ".join(CATS) + """ FROM s2) ON """ + ", ".join(CATS) + """
            INTO NAME column_name VALUE value)
      GROUP BY 1, 2)
GROUP BY column_name"""),
    "correlation_matrix": _w(S2 + """,
cm AS (SELECT """ + ", ".join(
        f"CASE WHEN var_pop({a}) = 0 OR var_pop({b}) = 0 THEN NULL ELSE corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END"
        f" AS \"{a}|{b}\"" for a in CLEAN_NUMS for b in CLEAN_NUMS) + """ FROM s2)""", """
SELECT split_part(name, '|', 1) AS var1, split_part(name, '|', 2) AS var2, round(v, 6) AS corr
FROM cm UNPIVOT INCLUDE NULLS (v FOR name IN (COLUMNS(*)))"""),
    "target_correlation": _w(S2, "SELECT * FROM (" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(CASE WHEN var_pop({c}) = 0 THEN NULL "
        f"ELSE corr(CAST({c} AS DOUBLE), interest_rate) END, 6) AS corr FROM s2"
        for c in CLEAN_NUMS if c != "interest_rate") + ")"),
    "mean_by_grade": _w(S3, "SELECT grade, " + ", ".join(
        f"round(avg(CAST({c} AS DOUBLE)), 6) AS {c}" for c in CLEAN_NUMS + ["satis_pr_cred_lines"])
        + " FROM s3 GROUP BY grade"),
    "mean_by_subgrade": _w(S3, "SELECT sub_grade, " + ", ".join(
        f"round(avg(CAST({c} AS DOUBLE)), 6) AS {c}" for c in CLEAN_NUMS + ["satis_pr_cred_lines"])
        + " FROM s3 GROUP BY sub_grade"),
    "top_categories": _w(S3 + TOPS, """
SELECT column_name, value, n, CAST(rk AS INTEGER) AS rank FROM tops WHERE rk <= 15"""),
    "train_test_split": _w("", """
SELECT loan_id, CAST('0x'||substr(md5(loan_id),1,8) AS BIGINT) % 100 < 20 AS is_test FROM raw"""),
    "standardize": _w(STD, "SELECT loan_id, is_test, " + ", ".join(f"{_r(c)} AS {c}" for c in NUMS) + " FROM std"),
    "shrink_categories": _w(SHRUNK, "SELECT loan_id, is_test, " + ", ".join(CATS) + " FROM shr"),
    "label_encode": _w(ENC, "SELECT loan_id, is_test, " + ", ".join(CATS) + " FROM enc"),
    "loan_prepared": _w(ENC, "SELECT loan_id, interest_rate, " + ", ".join(f"{_r(c)} AS {c}" for c in NUMS)
                        + ", " + ", ".join(CATS) + ", is_test FROM enc"),
    # --- orders.o_totalprice profiles -------------------------------------
    "describe_numeric": """
SELECT 'o_totalprice' AS column_name, count(o_totalprice) AS count, round(avg(o_totalprice), 6) AS mean,
       round(stddev_samp(o_totalprice), 6) AS std, min(o_totalprice) AS min,
       round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS q50,
       round(quantile_cont(o_totalprice, 0.75), 6) AS q75, max(o_totalprice) AS max
FROM orders""",
    "iqr_fence": """
SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
       round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper
FROM (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)""",
    "label_encode_customers": """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS INTEGER) AS customer
FROM orders""",
    "histogram": """
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
w AS (SELECT lo, (hi - lo) / 50 AS width FROM r)
SELECT CAST(e.range AS INTEGER) AS bin, round(lo + e.range * width, 6) AS lo,
       round(lo + (e.range + 1) * width, 6) AS hi, coalesce(n, 0) AS n
FROM range(0, 50) e CROSS JOIN w LEFT JOIN (
  SELECT CAST(coalesce(least(floor((o_totalprice - lo) / nullif(width, 0)), 49), 0) AS INTEGER) AS bin,
         count(*) AS n
  FROM orders, w WHERE o_totalprice IS NOT NULL GROUP BY 1) f ON f.bin = e.range""",
    "density_curve": """
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, stddev_samp(o_totalprice) AS sd,
                  count(o_totalprice) AS n FROM orders),
p AS (SELECT lo, hi, n, (hi - lo) / 1000 AS width, sd * pow(CAST(n AS DOUBLE), -0.2) AS h, (hi - lo) / 99 AS step FROM s),
v AS (SELECT coalesce((o_totalprice - lo) / nullif(width, 0), 0) AS t FROM orders, p WHERE o_totalprice IS NOT NULL),
u AS (SELECT CAST(least(floor(t), 999) AS INTEGER) AS cell, t - least(floor(t), 999) AS part FROM v),
e AS (SELECT j, sum(m) AS m FROM (SELECT cell AS j, 1 - part AS m FROM u UNION ALL SELECT cell + 1, part FROM u) GROUP BY j),
g AS (SELECT CAST(range AS INTEGER) AS g FROM range(0, 100))
SELECT g.g AS point, round(lo + g.g * step, 6) AS x,
       round(sum(CASE WHEN abs((lo + g.g * step) - (lo + e.j * width)) <= 8 * h
                 THEN e.m * exp(-0.5 * pow(((lo + g.g * step) - (lo + e.j * width)) / h, 2)) / (h * n * sqrt(2 * pi())) ELSE 0 END), 12) AS density
FROM g, e, p GROUP BY g.g, lo, step""",
    "normal_fit": """
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS mu,
                  stddev_pop(o_totalprice) AS sigma FROM orders),
w AS (SELECT lo, (hi - lo) / 50 AS width, mu, sigma FROM r),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(0, 50))
SELECT bin, round(lo + (bin + 0.5) * width, 6) AS x,
       round(exp(-0.5 * ((lo + (bin + 0.5) * width) - mu) / sigma * ((lo + (bin + 0.5) * width) - mu) / sigma)
             / (sigma * sqrt(2 * pi())), 12) AS pdf,
       round(mu, 6) AS mu, round(sigma, 6) AS sigma
FROM bins, w""",
    "box_stats": """
WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS x FROM orders WHERE o_totalprice IS NOT NULL),
q AS (SELECT year, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM o GROUP BY year),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT f.year, f.n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       round(lf, 6) AS lower_fence, round(uf, 6) AS upper_fence,
       round((SELECT min(x) FROM o WHERE o.year = f.year AND x BETWEEN lf AND uf), 6) AS whisker_low,
       round((SELECT max(x) FROM o WHERE o.year = f.year AND x BETWEEN lf AND uf), 6) AS whisker_high,
       (SELECT count(*) FROM o WHERE o.year = f.year AND NOT (x BETWEEN lf AND uf)) AS n_outliers
FROM f""",
}

# --- one-feature ridge (encoded sub_grade), penalty by 10-fold CV ------------
# Sums per fold, training = total - fold, closed form w = Sxy / (Sxx + alpha)
# on centred sums, fold R^2 = 1 - SSE/SST from the fold's own sums.
RIDGE1 = ENC + """,
d AS (
 SELECT loan_id, is_test, CAST(sub_grade AS DOUBLE) AS x, interest_rate AS y,
        CAST('0x'||substr(md5(loan_id),1,8) AS BIGINT) % 100 AS bucket
 FROM enc),
fs AS (
 SELECT bucket % 10 AS fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(x*y) AS sxy,
        sum(y*y) AS syy
 FROM d WHERE NOT is_test GROUP BY 1),
tot AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy FROM fs),
al AS (SELECT CAST(unnest([0.1, 1.0, 10.0]) AS DOUBLE) AS alpha),
fit AS (
 SELECT al.alpha, fs.*,
        ((tot.sxy - fs.sxy) - (tot.sx - fs.sx) * (tot.sy - fs.sy) / (tot.n - fs.n))
        / ((tot.sxx - fs.sxx) - (tot.sx - fs.sx) * (tot.sx - fs.sx) / (tot.n - fs.n) + al.alpha) AS w,
        (tot.sx - fs.sx) / (tot.n - fs.n) AS mx, (tot.sy - fs.sy) / (tot.n - fs.n) AS my
 FROM al, fs, tot),
cv AS (
 SELECT alpha, avg(1 - (syy - 2*b*sy - 2*w*sxy + n*b*b + 2*b*w*sx + w*w*sxx) / (syy - sy*sy/n)) AS r2
 FROM (SELECT *, my - w*mx AS b FROM fit) GROUP BY alpha),
best AS (SELECT alpha FROM cv ORDER BY r2 DESC, alpha LIMIT 1),
model AS (
 SELECT best.alpha, (tot.sxy - tot.sx*tot.sy/tot.n) / (tot.sxx - tot.sx*tot.sx/tot.n + best.alpha) AS w,
        tot.sx / tot.n AS mx, tot.sy / tot.n AS my
 FROM best, tot),
m1 AS (SELECT alpha, w, my - w*mx AS b FROM model)"""

# --- the charted loan columns ----------------------------------------------------


def _on_loans(key: str, col: str) -> str:
    """The chart SQL of an orders key over a column of the loans."""
    body = SQL[key].strip().removeprefix("WITH ").replace("o_totalprice", col).replace("FROM orders", "FROM raw")
    return "WITH " + LOAN_LIKE.strip() + ",\n" + body


SQL["income_histogram"] = _on_loans("histogram", "annual_income")
SQL["income_density"] = _on_loans("density_curve", "annual_income")
SQL["debt_normal_fit"] = _on_loans("normal_fit", "debt_to_income")
SQL["income_box"] = _w("""
, x AS (SELECT annual_income AS x FROM raw WHERE annual_income IS NOT NULL),
q AS (SELECT count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM x),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)""", """
SELECT n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       round(lf, 6) AS lower_fence, round(uf, 6) AS upper_fence,
       round((SELECT min(x) FROM x WHERE x BETWEEN lf AND uf), 6) AS whisker_low,
       round((SELECT max(x) FROM x WHERE x BETWEEN lf AND uf), 6) AS whisker_high,
       (SELECT count(*) FROM x WHERE NOT (x BETWEEN lf AND uf)) AS n_outliers
FROM f""")
SQL["after_mostly_zero"] = _w(OUTL, """
SELECT loan_id, open_credit_lines, num_satisfactory_accounts FROM outl""")

# --- correlations over the rows where both columns have a value ---------------
RAW_NUMS = ["interest_rate", "term", "loan_amount", "emp_length", "annual_income", "debt_to_income", "annual_income_joint",
            "debt_to_income_joint", "months_since_90d_late", "months_since_last_delinq", "months_since_last_credit_inquiry",
            "open_credit_lines", "num_satisfactory_accounts", "delinq_2y", "num_collections_last_12m", "tax_liens", "installment"]


def _pair(a: str, b: str) -> str:
    own = "var_pop(CASE WHEN {1} IS NOT NULL THEN CAST({0} AS DOUBLE) END)"
    return (f"CASE WHEN coalesce({own.format(a, b)}, 0) = 0 OR coalesce({own.format(b, a)}, 0) = 0 THEN NULL "
            f"ELSE corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END AS \"{a}|{b}\"")


SQL["correlation_pairwise"] = _w("""
, cm AS (SELECT """ + ", ".join(_pair(a, b) for a in RAW_NUMS for b in RAW_NUMS) + """ FROM raw)""", """
SELECT split_part(name, '|', 1) AS var1, split_part(name, '|', 2) AS var2, round(v, 6) AS corr
FROM cm UNPIVOT INCLUDE NULLS (v FOR name IN (COLUMNS(*)))""")

# --- the whole of lineitem, column by column -----------------------------------
LINEITEM = [("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"), ("l_linenumber", "integer"),
            ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"),
            ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "timestamp")]


def _column(i: int, c: str, family: str) -> str:
    if family in ("integer", "float"):
        x = f"CAST({c} AS DOUBLE)"
        own = (f"count_if({c} = 0) AS n_zero, round(count_if({c} = 0) * 100.0::DOUBLE / count(*), 6) AS pct_zero, round(avg({x}), 4) AS mean, "
               f"round(stddev_samp({x}), 6) AS std, min({x}) AS min, " + ", ".join(
                   f"round(quantile_cont({x}, {q}), 6) AS q{int(100 * q)}" for q in (0.25, 0.5, 0.75))
               + f", max({x}) AS max, NULL::VARCHAR AS min_text, NULL::VARCHAR AS max_text")
    else:
        own = ("NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, "
               f"CAST(min({c}) AS VARCHAR), CAST(max({c}) AS VARCHAR)")
    return (f"SELECT '{c}' AS column_name, {i} AS ordinal, '{family}' AS dtype_family, count(*) AS n_rows, count({c}) AS n_non_null, "
            f"count(*) - count({c}) AS n_missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS pct_missing, {own} FROM lineitem")


SQL["describe_table"] = "\nUNION ALL ".join(_column(i + 1, c, f) for i, (c, f) in enumerate(LINEITEM))

SQL.update({
    "ridge_one_feature": _w(RIDGE1, """
SELECT alpha, round(w, 6) AS coefficient, round(b, 6) AS intercept FROM m1"""),
    "ridge_predict": _w(RIDGE1, """
SELECT d.loan_id, d.is_test, round(m1.b + m1.w * d.x, 6) AS prediction FROM d, m1"""),
    "regression_metrics": _w(RIDGE1, """
SELECT CASE WHEN d.is_test THEN 'test' ELSE 'train' END AS split,
       round(sqrt(sum((d.y - (m1.b + m1.w*d.x)) * (d.y - (m1.b + m1.w*d.x))) / count(*)), 6) AS rmse,
       round(1 - sum((d.y - (m1.b + m1.w*d.x)) * (d.y - (m1.b + m1.w*d.x)))
                 / (sum(d.y*d.y) - sum(d.y)*sum(d.y)/count(*)), 6) AS r2
FROM d, m1 GROUP BY 1"""),
    "learning_curve": _w(RIDGE1 + """,
bs AS (SELECT bucket, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(y*y) AS syy
       FROM d WHERE NOT is_test GROUP BY bucket),
cum AS (SELECT bucket, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx,
               sum(sxy) OVER w AS sxy, sum(syy) OVER w AS syy
        FROM bs WINDOW w AS (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
te AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(y*y) AS syy
       FROM d WHERE is_test),
pf AS (SELECT p.bucket AS p, bs.bucket % 10 AS fold, sum(bs.n) AS n, sum(bs.sx) AS sx, sum(bs.sy) AS sy, sum(bs.sxx) AS sxx,
              sum(bs.sxy) AS sxy, sum(bs.syy) AS syy
       FROM bs p JOIN bs ON bs.bucket <= p.bucket GROUP BY 1, 2),
pt AS (SELECT bucket AS p, n AS tn, sx AS tx, sy AS ty, sxx AS txx, sxy AS txy FROM cum),
pw AS (SELECT pf.*, alpha, tn - n AS rn, tx - sx AS rx, ty - sy AS ry,
              ((txy - sxy) - (tx - sx)*(ty - sy)/(tn - n)) / ((txx - sxx) - (tx - sx)*(tx - sx)/(tn - n) + alpha) AS w
       FROM pf JOIN pt USING (p), al WHERE tn - n >= 2),
pr AS (SELECT p, alpha, avg(CASE WHEN syy - sy*sy/n > 0 THEN
              1 - (syy - 2*b*sy - 2*w*sxy + n*b*b + 2*b*w*sx + w*w*sxx) / (syy - sy*sy/n) END) AS r2
       FROM (SELECT *, ry/rn - w*rx/rn AS b FROM pw) GROUP BY p, alpha),
pa AS (SELECT cum.bucket AS p, al.alpha FROM cum, al LEFT JOIN pr ON pr.p = cum.bucket AND pr.alpha = al.alpha
       QUALIFY row_number() OVER (PARTITION BY cum.bucket ORDER BY coalesce(pr.r2, 0) DESC, al.alpha) = 1),
cf AS (SELECT cum.*, (sxy - sx*sy/n) / (sxx - sx*sx/n + pa.alpha) AS w FROM cum JOIN pa ON pa.p = cum.bucket WHERE n >= 2),
cm AS (SELECT *, sy/n - w*sx/n AS b FROM cf)""",
"""
SELECT CAST(cm.n AS BIGINT) AS n_train,
       round(sqrt(greatest(cm.syy - 2*cm.b*cm.sy - 2*cm.w*cm.sxy + cm.n*cm.b*cm.b + 2*cm.b*cm.w*cm.sx
                           + cm.w*cm.w*cm.sxx, 0) / cm.n), 6) AS train_rmse,
       round(sqrt(greatest(te.syy - 2*cm.b*te.sy - 2*cm.w*te.sxy + te.n*cm.b*cm.b + 2*cm.b*cm.w*te.sx
                           + cm.w*cm.w*te.sxx, 0) / te.n), 6) AS test_rmse
FROM cm, te"""),
})
