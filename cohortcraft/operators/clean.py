"""Cleaning steps of the loan analysis (B1-B16, C1-C8, M1, M2) and the
reference order in which they are applied.

Each step is a ``DataFrame -> DataFrame`` projection or filter, so a chain
of them is one pipelined stage that Catalyst fuses into the scan; the
only jobs a step may start itself are one-row parameter aggregations
(modes, zero shares) that decide values or dropped columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import binarize as _binarize, pick, safe_ratio as _safe_ratio
from . import profile

# Fixed values of the reference analysis (column names and cut-offs).
LEAKAGE_COLUMNS = ["installment", "loan_status", "initial_listing_status", "disbursement_method",
                   "balance", "paid_total", "paid_principal", "paid_interest", "paid_late_fees"]
MOSTLY_ZERO_COLUMNS = ["delinq_2y", "num_collections_last_12m", "current_accounts_delinq",
                       "num_accounts_120d_past_due", "num_accounts_30d_past_due", "tax_liens"]
SINGLE_COLUMNS = ["annual_income", "verified_income", "debt_to_income"]
JOINT_COLUMNS = ["annual_income_joint", "verification_income_joint", "debt_to_income_joint"]
ZERO_FILL_COLUMNS = ["months_since_90d_late", "months_since_last_delinq"]
MODE_FILL_COLUMNS = ["months_since_last_credit_inquiry", "verified_income"]
MONTHS_COLUMNS = ["months_since_90d_late", "months_since_last_delinq", "months_since_last_credit_inquiry"]
INCOME_FENCE = 170000.0          # Q3 + 1.5 IQR of the reference's income column
INCOME_MAX = 1.5e6               # outlier cut
TENURE_CUTOFF = 10               # emp_length >= 10 -> 1
UNVERIFIED = "Not Verified"
INDIVIDUAL = "individual"
OTHER = "other"


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """Drop columns (names not present are ignored)."""
    return df.drop(*[c for c in cols if c in df.columns])


def binarize_column(df: DataFrame, col: str, cutoff, out: str | None = None,
                    drop_source: bool = True) -> DataFrame:
    """``out = 1 if col >= cutoff else 0`` (NULL -> 0), appended at the end."""
    out = out or f"{col}1"
    df = df.withColumn(out, _binarize(col, cutoff))
    return df.drop(col) if drop_source else df


def remove_outliers(df: DataFrame, col: str, max_value: float) -> DataFrame:
    """Keep rows with ``col <= max_value``; rows with a NULL ``col`` go too
    (a NaN comparison is false in pandas as well).  Pushed to the scan."""
    return df.filter(F.col(col) <= max_value)


def resolve_pairs(df: DataFrame, flag: str, value: str, singles, joints,
                  drop_joint: bool = True) -> DataFrame:
    """For each (single, joint) pair keep the single value where
    ``flag == value`` and the joint value elsewhere; then drop the joint
    columns and the flag."""
    df = df.withColumns({s: pick(flag, value, s, j) for s, j in zip(singles, joints)})
    return drop_columns(df, list(joints) + [flag]) if drop_joint else df


def impute_constant(df: DataFrame, values: dict) -> DataFrame:
    """M1: fill NULLs with constants per column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def impute_mode(df: DataFrame, cols, fit_df: DataFrame | None = None) -> DataFrame:
    """M2: fill NULLs with the column's mode (ties -> smallest), fitted on
    ``fit_df`` (default: ``df`` itself, as in the reference, before the
    split).  All modes are one scalar subquery: one small aggregation job."""
    cols = list(cols)
    mode = profile.scalars(profile.mode_row(fit_df if fit_df is not None else df, cols))
    return df.withColumns({c: F.coalesce(F.col(c), mode[c]) for c in cols})


def add_ratio(df: DataFrame, out: str, num: str, den: str) -> DataFrame:
    """``out = num / den`` with 0/0 (and x/0) -> 0."""
    return df.withColumn(out, _safe_ratio(num, den))


def mostly_zero_report(df: DataFrame, cols, threshold_pct: float = 90.0) -> DataFrame:
    """B3 decision table: column_name, zero_pct, dropped (zero share >= threshold)."""
    cols = [c for c in cols if c in df.columns]
    return profile.zero_shares(df, cols).select(
        "column_name", "zero_pct", (F.col("zero_pct") >= threshold_pct).alias("dropped"))


def drop_mostly_zero(df: DataFrame, cols, threshold_pct: float = 90.0) -> DataFrame:
    """Drop the candidate columns whose zero share is at least the
    threshold.  The decision needs one one-row aggregation."""
    rep = mostly_zero_report(df, cols, threshold_pct)
    drop = [r["column_name"] for r in rep.filter("dropped").select("column_name").collect()]
    return drop_columns(df, drop)


def top_rows(df: DataFrame, col: str, k: int = 5, tie: str | None = None) -> DataFrame:
    """G1: the k rows with the largest ``col`` (``TakeOrderedAndProject``)."""
    order = [F.col(col).desc()] + ([F.col(tie).asc()] if tie else [])
    return df.orderBy(*order).limit(k)


# --- the reference's cleaning sequence ------------------------------------

def loans_before_imputation(raw: DataFrame) -> DataFrame:
    """Steps up to the missing-value report, in the reference's order:
    leakage columns and issue month dropped, tenure binarised, income
    outliers removed, mostly-zero columns dropped, joint applications
    merged into the single columns."""
    df = drop_columns(raw, LEAKAGE_COLUMNS + ["issue_month"])
    df = binarize_column(df, "emp_length", TENURE_CUTOFF, "emp_length1")
    df = remove_outliers(df, "annual_income", INCOME_MAX)
    df = drop_columns(df, MOSTLY_ZERO_COLUMNS)
    return resolve_pairs(df, "application_type", INDIVIDUAL, SINGLE_COLUMNS, JOINT_COLUMNS)


def loans_cleaned(raw: DataFrame) -> DataFrame:
    """All cleaning: months-since columns 0-filled, inquiry months and
    verification filled with their modes, job title with 'other'."""
    df = loans_before_imputation(raw)
    df = impute_constant(df, {c: 0 for c in ZERO_FILL_COLUMNS})
    df = impute_mode(df, MODE_FILL_COLUMNS)
    return impute_constant(df, {"emp_title": OTHER})


def loans_with_ratio(raw: DataFrame) -> DataFrame:
    """Cleaned table plus the satisfactory-accounts-per-credit-line ratio."""
    return add_ratio(loans_cleaned(raw), "satis_pr_cred_lines", "num_satisfactory_accounts",
                     "open_credit_lines")
