"""Named queries: key -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver's tables under ``sf_dir`` (through the fixture
views of ``cohortcraft.sources``) and runs over all of their rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import clean as C
from ..operators import features as M
from ..operators import profile as P
from ..operators import retention as R
from ..operators import sketches as K
from ..operators import summaries as S
from ..session import written
from ..sources import customer_period_from_orders, loan_like, test_table
from ..sources.bucketed import write_fact
from . import loan_models as LM

Query = Callable[[SparkSession, str], DataFrame]


def _cp(fn) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(customer_period_from_orders(spark, sf_dir))
    q.__doc__ = fn.__doc__
    q.__name__ = getattr(fn, "__name__", "query")
    return q


def _bucketed_summary(cp: DataFrame) -> DataFrame:
    """The retention table from a fact bucketed by customer: no exchange on the customer after the write."""
    spark = cp.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return R.summary(write_fact(cp, f"fact_{uuid.uuid4().hex}", buckets))


def _sketched_changes(cp: DataFrame) -> DataFrame:
    """New, lost and existing customers from one stored sketch per period."""
    return K.estimated_changes(written(K.period_sketches(cp)))


def _described_table(df: DataFrame) -> DataFrame:
    """All columns of a table: a stored one-scan summary, then exact quartiles."""
    # means of values with two decimals often end just at half of the sixth place
    return S.described(written(S.summarise(df)), df).withColumn("mean", rnd("mean", 4))


RETENTION: dict[str, Query] = {
    "retention_summary": _cp(R.summary),
    "revenue_by_period": _cp(R.revenue_by_period),
    "new_customer_revenue": _cp(R.new_customer_revenue),
    "existing_customer_growth": _cp(R.existing_customer_growth),
    "attrition_revenue": _cp(R.attrition_revenue),
    "existing_revenue_current": _cp(R.existing_revenue_current),
    "existing_revenue_prior": _cp(R.existing_revenue_prior),
    "customers_by_period": _cp(R.customers_by_period),
    "customers_prev_period": _cp(R.customers_prev_period),
    "new_customers": _cp(R.new_customers),
    "lost_customers": _cp(R.lost_customers),
    "period_spine": _cp(R.period_spine),
    "customer_transitions": _cp(R.transitions),
    "new_customers_anti": _cp(R.new_by_anti_join),
    "existing_customers_semi": _cp(R.existing_by_semi_join),
    "customers_except": _cp(R.except_counts),
    "metrics_union": _cp(R.metrics_long),
    "revenue_sum_mean": _cp(R.revenue_sum_mean),
    "distinct_customers": _cp(R.distinct_counts),
    "loyalty_distribution": _cp(R.loyalty),
    "revenue_rollup": _cp(R.revenue_rollup),
    "retention_bucketed": _cp(_bucketed_summary),
    "sketched_changes": _cp(_sketched_changes),
}


def _loans(fn) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(loan_like(spark, sf_dir))
    q.__doc__ = fn.__doc__
    return q


def _orders(fn) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(test_table(spark, sf_dir, "orders"))
    q.__doc__ = fn.__doc__
    return q


# Rows shown by the inspection filters (the reference's ``head()`` of a sorted frame).
INSPECT_COLUMNS = ["loan_id", "annual_income", "verified_income", "emp_title"]


def _numeric_no_split(df: DataFrame) -> list[str]:
    return [c for c in P.numeric_columns(df) if c != "split_bucket"]


def unverified_top_income(raw: DataFrame) -> DataFrame:
    """C1 + G1: unverified incomes above the IQR upper fence, top 5."""
    fence = P.upper_fence(raw, "annual_income")
    return C.top_rows(raw.filter((F.col("annual_income") > fence)
                                 & (F.col("verified_income") == C.UNVERIFIED)),
                      "annual_income", 5, "loan_id").select(*INSPECT_COLUMNS)


def extreme_income(raw: DataFrame) -> DataFrame:
    """C2 + G1: incomes above the outlier cut, top 5."""
    return C.top_rows(raw.filter(F.col("annual_income") > C.INCOME_MAX), "annual_income", 5,
                      "loan_id").select(*INSPECT_COLUMNS)


def _after_outliers(raw: DataFrame) -> DataFrame:
    df = C.drop_columns(raw, C.LEAKAGE_COLUMNS + ["issue_month"])
    df = C.binarize_column(df, "emp_length", C.TENURE_CUTOFF, "emp_length1")
    return C.remove_outliers(df, "annual_income", C.INCOME_MAX)


def _without_mostly_zero(raw: DataFrame) -> DataFrame:
    """What is left of candidate columns once those with 90 % zeros are dropped."""
    candidates = [*C.MOSTLY_ZERO_COLUMNS, "open_credit_lines", "num_satisfactory_accounts"]
    left = C.drop_mostly_zero(_after_outliers(raw), candidates)
    return left.select("loan_id", *[c for c in candidates if c in left.columns])


def _standardized(raw: DataFrame) -> DataFrame:
    p = M.prepare_loans(raw)
    return p.df.select(M.KEY, M.SPLIT_COLUMN, *[rnd(c).alias(c) for c in p.numericals])


def _shrunk(raw: DataFrame) -> DataFrame:
    df, cats = M.filled_categories(raw)
    shr = M.fit_shrink(df.filter(~F.col(M.SPLIT_COLUMN)), cats)
    return shr.transform(df).select(M.KEY, M.SPLIT_COLUMN, *cats)


def _encoded(raw: DataFrame) -> DataFrame:
    p = M.prepare_loans(raw)
    return p.df.select(M.KEY, M.SPLIT_COLUMN, *p.categoricals)


def _correlations(cleaned: DataFrame) -> DataFrame:
    return P.correlations(cleaned, _numeric_no_split(cleaned))


def _target_correlation(cleaned: DataFrame) -> DataFrame:
    return P.target_correlation(cleaned, [c for c in _numeric_no_split(cleaned) if c != M.LABEL], M.LABEL)


def _customer_codes(orders: DataFrame) -> DataFrame:
    """M6 on a column with many labels: the customer of each order, encoded as text."""
    named = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    return M.fit_encode(named, ["customer"]).transform(named)


def _prepared(raw: DataFrame) -> DataFrame:
    p = M.prepare_loans(raw)
    return p.df.select(M.KEY, M.LABEL, *[rnd(c).alias(c) if c in p.numericals else F.col(c)
                                         for c in p.features], M.SPLIT_COLUMN)


def _top_categories(raw: DataFrame) -> DataFrame:
    df, cats = M.filled_categories(raw)
    return P.top_values(df.filter(~F.col(M.SPLIT_COLUMN)), cats, M.TOP_CATEGORIES)


def _with_year(orders: DataFrame) -> DataFrame:
    return orders.select(F.year("o_orderdate").cast("int").alias("year"), "o_totalprice")


LOANS: dict[str, Query] = {
    "table_profile": _loans(P.table_profile),
    "value_counts": _loans(lambda d: P.value_counts(d, ["state", "issue_month"])),
    "value_shares": _loans(lambda d: P.value_counts(d, ["emp_length", "homeownership"], normalize=True)),
    "binarize_tenure": _loans(lambda d: C.binarize_column(d, "emp_length", C.TENURE_CUTOFF, "emp_length1",
                                                          drop_source=False)
                              .select("loan_id", "emp_length", "emp_length1")),
    "unverified_top_income": _loans(unverified_top_income),
    "extreme_income": _loans(extreme_income),
    "remove_outliers": _loans(lambda d: C.remove_outliers(d, "annual_income", C.INCOME_MAX)
                              .select("loan_id", "annual_income")),
    "drop_mostly_zero": _loans(lambda d: C.mostly_zero_report(_after_outliers(d), C.MOSTLY_ZERO_COLUMNS)),
    "after_mostly_zero": _loans(_without_mostly_zero),
    "income_histogram": _loans(lambda d: P.histogram(d, "annual_income", 50)),
    "income_density": _loans(lambda d: P.density(d, "annual_income")),
    "income_box": _loans(lambda d: P.box_stats(d, "annual_income")),
    "debt_normal_fit": _loans(lambda d: P.normal_fit(d, "debt_to_income", 50)),
    "zero_share": _loans(lambda d: P.zero_shares(_after_outliers(d),
                                                 [c for c in C.MOSTLY_ZERO_COLUMNS if c in d.columns])),
    "resolve_joint": _loans(lambda d: C.resolve_pairs(d, "application_type", C.INDIVIDUAL, C.SINGLE_COLUMNS,
                                                      C.JOINT_COLUMNS)
                            .select("loan_id", *C.SINGLE_COLUMNS)),
    "missing_report": _loans(lambda d: P.missing_shares(C.loans_before_imputation(d))),
    "zero_counts": _loans(lambda d: P.zero_counts(C.loans_before_imputation(d), C.MONTHS_COLUMNS)),
    "mode_values": _loans(lambda d: P.modes(C.loans_before_imputation(d), C.MODE_FILL_COLUMNS)),
    "impute_constant": _loans(lambda d: C.impute_constant(
        C.loans_before_imputation(d), {**{c: 0 for c in C.ZERO_FILL_COLUMNS}, "emp_title": C.OTHER})
        .select("loan_id", *C.ZERO_FILL_COLUMNS, "emp_title")),
    "impute_mode": _loans(lambda d: C.impute_mode(C.loans_before_imputation(d), C.MODE_FILL_COLUMNS)
                          .select("loan_id", *C.MODE_FILL_COLUMNS)),
    "completeness_gate": _loans(lambda d: P.completeness(C.loans_cleaned(d))),
    "ratio_feature": _loans(lambda d: C.add_ratio(d, "satis_pr_cred_lines", "num_satisfactory_accounts",
                                                  "open_credit_lines").select("loan_id", "satis_pr_cred_lines")),
    "describe_text": _loans(lambda d: P.describe_text(C.loans_cleaned(d),
                                                      P.text_columns(C.loans_cleaned(d), exclude=("loan_id",)))),
    "correlation_matrix": _loans(lambda d: _correlations(written(C.loans_cleaned(d)))),
    "correlation_pairwise": _loans(lambda d: P.correlations(d, [c for c in _numeric_no_split(d) if c != "issue_month"])),
    "target_correlation": _loans(lambda d: _target_correlation(written(C.loans_cleaned(d)))),
    "mean_by_grade": _loans(lambda d: P.means_by(C.loans_with_ratio(d), "grade",
                                                 _numeric_no_split(C.loans_with_ratio(d)))),
    "mean_by_subgrade": _loans(lambda d: P.means_by(C.loans_with_ratio(d), "sub_grade",
                                                    _numeric_no_split(C.loans_with_ratio(d)))),
    "top_categories": _loans(_top_categories),
    "train_test_split": _loans(lambda d: M.split(d).select(M.KEY, M.SPLIT_COLUMN)),
    "standardize": _loans(_standardized),
    "shrink_categories": _loans(_shrunk),
    "label_encode": _loans(_encoded),
    "loan_prepared": _loans(_prepared),
}

ORDERS: dict[str, Query] = {
    "describe_numeric": _orders(lambda o: P.describe_numeric(o, ["o_totalprice"])),
    "iqr_fence": _orders(lambda o: P.iqr_fence(o, "o_totalprice")),
    "label_encode_customers": _orders(_customer_codes),
    "histogram": _orders(lambda o: P.histogram(o, "o_totalprice", 50)),
    "density_curve": _orders(lambda o: P.density(o, "o_totalprice")),
    "normal_fit": _orders(lambda o: P.normal_fit(o, "o_totalprice", 50)),
    "describe_table": lambda spark, sf_dir: _described_table(test_table(spark, sf_dir, "lineitem")),
    "box_stats": _orders(lambda o: P.box_stats(_with_year(o), "o_totalprice", by="year")),
}


MODELS: dict[str, Query] = {
    "ridge_one_feature": _loans(LM.ridge_one_feature),
    "ridge_predict": _loans(LM.ridge_predict),
    "regression_metrics": _loans(LM.ridge_metrics),
    "learning_curve": _loans(LM.learning_curve_one),
    "learning_curve_all": _loans(LM.learning_curve_all),
    "ridge_cv": _loans(LM.ridge_cv_table),
    "ridge_coefficients": _loans(LM.ridge_coefficients),
    "random_forest_metrics": _loans(LM.forest_metrics),
    "gbt_metrics": _loans(LM.gbt_metrics),
    "forest_one_feature_metrics": _loans(LM.forest_one_feature_metrics),
    "feature_importance": _loans(LM.feature_importance),
    "model_summary": _loans(LM.model_summary),
}


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(RETENTION)
    out.update(LOANS)
    out.update(ORDERS)
    out.update(MODELS)
    return out
