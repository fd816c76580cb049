"""Scalar expressions (I1-I7, B7, B9, M3).  Each returns a ``Column``; none
is a Python UDF, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Doubles produced by different engines or task orders agree to ~1e-15
# relative; results meant for comparison are rounded to this many places.
DOUBLE_PLACES = 6


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, places: int = DOUBLE_PLACES) -> Column:
    """Round a double for reporting (half-up, like ``round`` in SQL)."""
    return F.round(_c(c).cast("double"), places)


def binarize(c, cutoff, true_value: int = 1, false_value: int = 0) -> Column:
    """``c >= cutoff`` -> 1 else 0.  NULL (a missing value) gives 0, as
    ``np.where(x >= k, 1, 0)`` does for NaN."""
    return F.when(_c(c) >= cutoff, F.lit(true_value)).otherwise(F.lit(false_value))


def pick(flag, value, single, joint) -> Column:
    """B8 helper: ``single`` when ``flag == value``, else ``joint`` (a NULL
    flag takes the joint value, as ``np.where`` does)."""
    return F.when(_c(flag) == F.lit(value), _c(single)).otherwise(_c(joint))


def safe_ratio(a, b, fill: float = 0.0) -> Column:
    """A / b with 0/0 -> ``fill``.  x/0 also gives ``fill`` (ANSI division
    would raise; pandas would give inf, which the reference then scales)."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(fill))


def bucket_hash(key, buckets: int = 100) -> Column:
    """M3: 0..buckets-1 from the first 32 bits of md5(key).  Deterministic per
    key, so a split is reproducible under any partitioning and the same rows
    are chosen by DuckDB's ``cast('0x'||substr(md5(k),1,8) as bigint) % n``."""
    return F.conv(F.substring(F.md5(_c(key).cast("string")), 1, 8), 16, 10).cast("bigint") % buckets


def corr_pairwise(a, b) -> Column:
    """Pearson correlation over rows where both are non-NULL.  A constant
    column gives NULL (pandas: NaN) instead of ANSI's division error."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    both = a.isNotNull() & b.isNotNull()
    ap, bp = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(ap, bp), F.sqrt(F.var_pop(ap) * F.var_pop(bp)))
