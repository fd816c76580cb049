"""Profiling aggregates.

Every report is one or two aggregations over the input, whatever the number
of columns: per-column statistics are computed side by side in a single
``agg`` and turned into rows afterwards (``inline`` of an array of structs
over the one-row result), never by looping over columns with one job each.
Frequency-style reports go through ``groupBy(column_name, value)`` with a
map-side partial aggregate, so a hot value is combined before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import rnd
from ..functions.linalg import masked_products


# --- schema helpers (B12, B13, E20) --------------------------------------

def dtype_family(dt: T.DataType) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, T.StringType):
        return "text"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "other"


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns in table order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude=()) -> list[str]:
    """Text (categorical) columns in table order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def _rows(agg_row: DataFrame, structs: list[Column]) -> DataFrame:
    """One-row aggregate -> one row per struct."""
    return agg_row.select(F.inline(F.array(*structs)))


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value-as-text) pairs of ``cols``; NULL values dropped."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                      for c in cols])
    return df.select(F.inline(pairs)).filter(F.col("value").isNotNull())


# --- A5: shape and types --------------------------------------------------

def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: column_name, ordinal, dtype_family,
    n_rows, n_non_null.  One scan."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count(F.col(f.name)).alias(f"__c{i}")
                                                for i, f in enumerate(fields)]
    row = df.agg(*aggs)
    return _rows(row, [F.struct(F.lit(f.name).alias("column_name"), F.lit(i + 1).alias("ordinal"),
                                F.lit(dtype_family(f.dataType)).alias("dtype_family"),
                                F.col("__n").alias("n_rows"), F.col(f"__c{i}").alias("n_non_null"))
                       for i, f in enumerate(fields)])


# --- E5, E6, E10, E15: frequencies ------------------------------------------

def value_counts(df: DataFrame, cols: list[str], normalize: bool = False) -> DataFrame:
    """Rows per non-NULL value of each column: column_name, value, n
    and, with ``normalize``, pct = share of the column's non-NULL rows x 100.
    The totals are a second, tiny aggregation joined back on column_name."""
    counts = _long(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    if not normalize:
        return counts
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("__total"))
    return (counts.join(totals, "column_name")
                  .select("column_name", "value", "n",
                          rnd(F.col("n") * 100.0 / F.col("__total")).alias("pct")))


def describe_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, unique, top (most frequent; ties -> smallest), freq."""
    counts = _long(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("value")))
    return (counts.groupBy("column_name")
                  .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("b"))
                  .select("column_name", "count", "unique", F.col("b.value").alias("top"),
                          (-F.col("b.neg_n")).alias("freq")))


def mode_row(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the most frequent non-NULL value of each column in
    its own type; ties -> smallest.  Value counts of all columns come from one
    pass (grouping sets), then a min over (-count, value): both steps
    aggregate partially, so no single task holds all distinct values."""
    counts = df.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(
        F.count(F.lit(1)).alias("__n"))
    # a value is non-NULL only in the rows of its own column's grouping set
    best = [F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col("__n")).alias("neg_n"), F.col(c).alias("v")))).alias(c)
            for c in cols]
    return counts.agg(*best).select(*[F.col(c)["v"].alias(c) for c in cols])


def mode_value(df: DataFrame, c: str) -> Column:
    """E15 as a scalar-subquery Column (for imputation)."""
    return mode_row(df, [c]).scalar()


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """column_name, mode (as text), one row per column."""
    return _rows(mode_row(df, cols), [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("mode"))
                                      for c in cols])


def top_values(df: DataFrame, cols: list[str], top: int = 15) -> DataFrame:
    """The ``top`` most frequent values per column (ties -> smaller
    value first): column_name, value, n, rank.  Catalyst puts a partial
    ``WindowGroupLimit`` before the window's exchange, so each map task only
    ships its own top rows per column."""
    counts = _long(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


# --- E9, E11-E14, E18: per-column statistics ------------------------------

def _quantiles(c: Column, probs, approx: bool, accuracy: int = 10000) -> Column:
    arr = F.array(*[F.lit(float(p)) for p in probs])
    if approx:
        return F.percentile_approx(c, arr, accuracy)
    return F.percentile(c, arr)


def scalars(stats: DataFrame) -> Column:
    """A one-row aggregate as one struct-valued scalar subquery (evaluated
    once however many of its fields the plan uses)."""
    return stats.select(F.struct(*stats.columns).alias("s")).scalar()


# Share of the rows that fall between a target's two sketch edges is about
# 4 / SKETCH_ACCURACY (plus ties), so a group has at most ~4e6 distinct values
# there for 1e12 rows.
SKETCH_ACCURACY = 1_000_000
# Groups up to which their one-row-per-group statistics are broadcast.
MAX_GROUPS = 10_000


def few_groups(df: DataFrame, by: list[str]) -> bool:
    """Whether ``by`` has at most MAX_GROUPS values (one pass over the keys,
    made distinct in the map tasks)."""
    return df.select(*by).distinct().limit(MAX_GROUPS + 1).count() <= MAX_GROUPS


def _beside(df: DataFrame, groups: DataFrame, by: list[str], few: bool) -> DataFrame:
    """Each row with its group's row: a broadcast of at most MAX_GROUPS rows,
    else a shuffled join (whose hot groups AQE splits)."""
    return df.join(F.broadcast(groups) if few else groups, by)


def exact_quantiles(df: DataFrame, col: str, probs, by: list[str] | None = None,
                    accuracy: int = SKETCH_ACCURACY, few: bool | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (the semantics of SQL
    ``percentile`` / ``quantile_cont`` and pandas) that scale with the data.

    ``percentile`` keeps every distinct value of a group in the one task that
    finishes the group; this does not:

    1. one aggregation per group: ``n`` and sketch quantiles
       (``percentile_approx``, rank error <= n/accuracy) just below and above
       each target, which bracket the target's value;
    2. one aggregation by (group, run): a value inside a bracket is a run of
       its own, all rows of a gap between brackets are one run; each run has
       its count, smallest and largest value.  Ties and gaps are combined in
       the map tasks;
    3. running counts over a group's few runs give the values at sorted
       positions floor/ceil((n-1)p): a bracket's value, or the end of a gap
       for a target one rank beyond its bracket (small n).

    Without groups the sketch is a scalar subquery.  Group rows are broadcast
    if there are at most MAX_GROUPS of them: ``few`` states that the caller
    knows so, None counts them.

    Returns ``by`` columns plus ``n`` and ``q`` (array of doubles, one per
    ``probs``).
    """
    by = list(by or [])
    probs = [float(p) for p in probs]
    m = 2.0 / accuracy
    edges = []
    for p in probs:
        edges += [max(0.0, p - m), min(1.0, p + m)]
    x = F.col("__x")
    data = df.select(*by, F.col(col).cast("double").alias("__x")).filter(x.isNotNull())
    sketch = F.percentile_approx("__x", F.array(*[F.lit(e) for e in edges]), accuracy).alias("__b")
    if by:
        rows = _beside(data, data.groupBy(*by).agg(sketch), by, few_groups(data, by) if few is None else few)
    else:
        rows = data.withColumn("__b", data.agg(sketch).scalar())
    return bracketed_quantiles(rows, probs, by)


def bracketed_quantiles(rows: DataFrame, probs, by: list[str]) -> DataFrame:
    """Steps 2 and 3 of ``exact_quantiles`` for rows (``by``, ``__x``, ``__b``): ``__b`` holds two values per
    target that bracket it, the same for all rows of a group."""
    x = F.col("__x")
    edge = [F.col("__b")[j] for j in range(2 * len(probs))]
    inside, gap = F.lit(False), F.lit(0)
    for lo, hi in zip(edge[::2], edge[1::2], strict=True):
        inside = inside | ((x >= lo) & (x <= hi))
    for e in edge:
        gap = gap + (x > e).cast("int")
    runs = (rows.select(*by, "__x", F.when(inside, x).alias("__value"), F.when(~inside, gap).alias("__gap"))
                .groupBy(*by, "__value", "__gap")
                .agg(F.count(F.lit(1)).alias("__c"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")))
    w = Window.partitionBy(*by)
    runs = (runs.withColumn("__end", F.sum("__c").over(w.orderBy("__lo")))
                .withColumn("__n", F.sum("__c").over(w)))
    first, last = F.col("__end") - F.col("__c"), F.col("__end") - 1

    def at(k: Column) -> Column:
        end = (F.when(k == first, F.col("__lo")).when((k == last) | F.col("__value").isNotNull(), F.col("__hi"))
                .otherwise(F.raise_error(F.lit("quantile outside its bracket")).cast("double")))
        return F.max(F.when((k >= first) & (k <= last), end))

    aggs = [F.max("__n").alias("n")]
    for i, p in enumerate(probs):
        h = (F.col("__n") - 1) * F.lit(p)
        aggs += [at(F.floor(h)).alias(f"__a{i}"), at(F.ceil(h)).alias(f"__b{i}"), F.max(h - F.floor(h)).alias(f"__f{i}")]
    between = [F.col(f"__a{i}") + F.col(f"__f{i}") * (F.col(f"__b{i}") - F.col(f"__a{i}")) for i in range(len(probs))]
    return runs.groupBy(*by).agg(*aggs).filter(F.col("n") > 0).select(*by, "n", F.array(*between).alias("q"))


def describe_numeric(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Count, mean, std (sample), min, 25%, 50%, 75%, max per column.

    Quartiles are exact with linear interpolation, as pandas (``exact_quantiles``;
    ``df.summary()`` is not used: its quartiles are approximate).
    ``approx=True`` uses sketch quartiles (one pass).  The moments of all
    columns come from one aggregation.
    """
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    stats = _rows(df.agg(*aggs), [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"),
                                           rnd(F.col(f"m{i}")).alias("mean"), rnd(F.col(f"s{i}")).alias("std"),
                                           F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
                                  for i, c in enumerate(cols)])
    # All columns' quartiles in one pipeline: (column_name, value) rows,
    # quantiles grouped by column_name.
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                 F.col(c).cast("double").alias("value")) for c in cols])))
    if approx:
        qs = long.groupBy("column_name").agg(_quantiles(F.col("value"), (0.25, 0.5, 0.75), True).alias("q"))
    else:
        qs = exact_quantiles(long, "value", (0.25, 0.5, 0.75), by=["column_name"], few=len(cols) <= MAX_GROUPS)
    qs = qs.select("column_name", rnd(F.col("q")[0]).alias("q25"), rnd(F.col("q")[1]).alias("q50"),
                   rnd(F.col("q")[2]).alias("q75"))
    # one row per described column on both sides: bounded by the schema, not the data
    return stats.join(F.broadcast(qs), "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def missing_shares(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """column_name, n_missing, pct_missing (x 100) and rank
    (from 1, most missing first); by default only columns with something
    missing (the reference's filter)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count_if(F.col(c).isNull()).alias(f"__m{i}")
                                                for i, c in enumerate(cols)]
    out = _rows(df.agg(*aggs), [F.struct(F.lit(c).alias("column_name"),
                                         F.col(f"__m{i}").alias("n_missing"),
                                         rnd(F.col(f"__m{i}") * 100.0 / F.col("__n")).alias("pct_missing"))
                                for i, c in enumerate(cols)])
    # one row per column of the table: the window's size is the schema's
    order = Window.orderBy(F.desc("n_missing"), F.asc("column_name"))
    out = out.withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("n_missing") > 0) if only_missing else out


def zero_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """zero_pct and nonzero_pct (= 100 - zero_pct; missing counts
    as non-zero, as ``isin([0]).mean()`` does)."""
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count_if(F.col(c) == 0).alias(f"__z{i}")
                                                for i, c in enumerate(cols)]
    return _rows(df.agg(*aggs), [F.struct(F.lit(c).alias("column_name"),
                                          rnd(F.col(f"__z{i}") * 100.0 / F.col("__n")).alias("zero_pct"),
                                          rnd(100 - F.col(f"__z{i}") * 100.0 / F.col("__n")).alias("nonzero_pct"))
                                 for i, c in enumerate(cols)])


def zero_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """How often 0 occurs in each column."""
    return _rows(df.agg(*[F.count_if(F.col(c) == 0).alias(f"__z{i}") for i, c in enumerate(cols)]),
                 [F.struct(F.lit(c).alias("column_name"), F.col(f"__z{i}").alias("n_zero"))
                  for i, c in enumerate(cols)])


def completeness(df: DataFrame) -> DataFrame:
    """One row - ``complete`` (no NULL anywhere) and the number of
    columns that still have a NULL."""
    flags = [F.max(F.col(c).isNull().cast("int")) for c in df.columns]
    n_bad = sum(flags[1:], flags[0]) if flags else F.lit(0)
    return df.agg(n_bad.alias("n_columns_missing")).select(
        (F.coalesce(F.col("n_columns_missing"), F.lit(0)) == 0).alias("complete"),
        F.coalesce(F.col("n_columns_missing"), F.lit(0)).cast("bigint").alias("n_columns_missing"))


def _q(df: DataFrame, col: str, probs, approx: bool) -> DataFrame:
    if approx:
        return df.agg(_quantiles(F.col(col).cast("double"), probs, True).alias("q"))
    return exact_quantiles(df, col, probs).select("q")


def iqr_fence(df: DataFrame, col: str, k: float = 1.5, approx: bool = False) -> DataFrame:
    """q1, q3, iqr, lower = q1 - k*iqr, upper = q3 + k*iqr (one row)."""
    q = _q(df, col, (0.25, 0.75), approx)
    iqr = F.col("q")[1] - F.col("q")[0]
    return q.select(rnd(F.col("q")[0]).alias("q1"), rnd(F.col("q")[1]).alias("q3"), rnd(iqr).alias("iqr"),
                    rnd(F.col("q")[0] - k * iqr).alias("lower"), rnd(F.col("q")[1] + k * iqr).alias("upper"))


def upper_fence(df: DataFrame, col: str, k: float = 1.5, approx: bool = False) -> Column:
    """E14 upper fence as a scalar-subquery Column (unrounded)."""
    q = _q(df, col, (0.25, 0.75), approx)
    return q.select((F.col("q")[1] + k * (F.col("q")[1] - F.col("q")[0])).alias("u")).scalar()


# --- E16, E17, E8: bivariate ------------------------------------------------

#: A variance below this share of the mean square is that of a constant column.
CONSTANT = 1e-13


def _corr_matrix(df: DataFrame, cols: list[str]) -> list[list[float | None]]:
    """Pearson correlations over the rows where both columns have a value (None for a constant column), from one pass."""
    n, s, q, p = masked_products(df, cols)
    k = len(cols)

    def corr(i: int, j: int) -> float | None:
        if n[i, j] < 1:
            return None
        a, b = n[i, j] * q[i, j] - s[i, j] ** 2, n[i, j] * q[j, i] - s[j, i] ** 2
        if a <= CONSTANT * n[i, j] * q[i, j] or b <= CONSTANT * n[i, j] * q[j, i]:
            return None
        return float((n[i, j] * p[i, j] - s[i, j] * s[j, i]) / math.sqrt(a * b))

    return [[corr(i, j) for j in range(k)] for i in range(k)]


def _places(x: float | None) -> float | None:
    return None if x is None else round(x, 6)


def correlations(df: DataFrame, cols: list[str], target: str | None = None) -> DataFrame:
    """Pearson correlation of every ordered pair (long form: var1,
    var2, corr); E17 with ``target``: column_name, corr with the target.

    One pass over the data, with or without NULLs (a pair's rows are those
    where both have a value): masked cross products from per-task numpy
    partials (``functions.linalg``); the k^2 results become a small frame.  A
    constant column gives NULL (pandas: NaN).
    """
    spark = df.sparkSession
    if target is not None:
        mat = _corr_matrix(df, [*cols, target])
        return spark.createDataFrame([(c, _places(mat[i][-1])) for i, c in enumerate(cols)], "column_name string, corr double")
    mat = _corr_matrix(df, cols)
    rows = [(a, b, _places(mat[i][j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return spark.createDataFrame(rows, "var1 string, var2 string, corr double")


def target_correlation(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Correlation of each column with the target (one column of E16)."""
    return correlations(df, cols, target)


def means_by(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Mean of every numeric column per group."""
    return df.groupBy(key).agg(*[rnd(F.avg(F.col(c).cast("double"))).alias(c) for c in cols])


# --- L1-L4: data behind the charts ----------------------------------------

def _range(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(F.col(col).cast("double")).alias("lo"), F.max(F.col(col).cast("double")).alias("hi"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """L1: equal-width bins between min and max (the max falls in the last
    bin): bin, lo, hi, n; empty bins have n = 0, a column without values has no
    bins.  min/max come from scalar subqueries."""
    r = scalars(_range(df, col))
    lo, hi = r["lo"], r["hi"]
    width = (hi - lo) / bins
    x = F.col(col).cast("double")
    b = F.least(F.floor(F.try_divide(x - lo, width)), F.lit(bins - 1))
    b = F.coalesce(b, F.lit(0)).cast("int")
    filled = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (every.join(filled, "bin", "left").filter(lo.isNotNull())
                 .select("bin", rnd(lo + F.col("bin") * width).alias("lo"),
                         rnd(lo + (F.col("bin") + 1) * width).alias("hi"),
                         F.coalesce("n", F.lit(0)).cast("long").alias("n")))


#: Bandwidths beyond which a kernel counts as 0: at most exp(-32) of its height is lost.
KERNEL_REACH = 8.0


def density(df: DataFrame, col: str, grid: int = 100, bins: int = 1000, places: int = 12) -> DataFrame:
    """L2: Gaussian kernel density on ``grid`` points between min and max,
    bandwidth h by Scott's rule (sample std x n^-1/5, as scipy's default).

    Linear binning: a value's mass is shared by the two ends of its cell
    (``bins`` cells of equal width w) in proportion to its place between them, so one scan leaves a count and a
    sum per cell.  Each end then adds its kernel to the grid points within KERNEL_REACH
    bandwidths only: O(n + bins x points in reach).  A density differs from the exact sum
    by at most (w/h)^2 / 8 + exp(-KERNEL_REACH^2 / 2) kernel heights, 1 / (h sqrt(2 pi)).
    """
    x = F.col(col).cast("double")
    stats = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd"),
                   F.count(x).alias("n"))
    st = scalars(stats)
    lo, hi, sd, n = st["lo"], st["hi"], st["sd"], st["n"]
    width, step = (hi - lo) / bins, (hi - lo) / (grid - 1)
    h = sd * F.pow(n.cast("double"), -0.2)
    place = F.coalesce(F.try_divide(x - lo, width), F.lit(0.0))
    cell = F.least(F.floor(place), F.lit(bins - 1)).cast("int")
    cells = (df.filter(x.isNotNull()).select(cell.alias("cell"), (place - cell).alias("part"))
             .groupBy("cell").agg(F.count(F.lit(1)).alias("c"), F.sum("part").alias("right")))
    ends = cells.select(F.inline(F.array(
        F.struct(F.col("cell").alias("end"), (F.col("c") - F.col("right")).alias("mass")),
        F.struct((F.col("cell") + 1).alias("end"), F.col("right").alias("mass")))))
    ends = ends.groupBy("end").agg(F.sum("mass").alias("mass")).select("mass", (lo + F.col("end") * width).alias("at"))
    reach = h * KERNEL_REACH
    first = F.coalesce(F.ceil(F.try_divide(F.col("at") - reach - lo, step)), F.lit(0))
    last = F.coalesce(F.floor(F.try_divide(F.col("at") + reach - lo, step)), F.lit(grid - 1))
    points = F.sequence(F.greatest(first - 1, F.lit(0)).cast("int"), F.least(last + 1, F.lit(grid - 1)).cast("int"))
    near = ends.filter(first <= last).select(F.explode(points).alias("point"), "mass", "at")
    off = lo + F.col("point") * step - F.col("at")
    z = F.try_divide(off, h)  # a constant column has no density
    k = F.when(F.abs(off) <= reach, F.try_divide(F.col("mass") * F.exp(-0.5 * z * z), h * n * math.sqrt(2 * math.pi)))
    summed = near.groupBy("point").agg(F.sum(k).alias("d"))
    every = df.sparkSession.range(grid).select(F.col("id").cast("int").alias("point"))
    return (every.join(summed, "point", "left").filter(lo.isNotNull())
                 .select("point", rnd(lo + F.col("point") * step, 6).alias("x"),
                         F.round(F.when(h > 0, F.coalesce("d", F.lit(0.0))), places).alias("density")))


def normal_fit(df: DataFrame, col: str, bins: int = 50, places: int = 12) -> DataFrame:
    """L3: maximum-likelihood normal (mean, population std) evaluated at the
    histogram's bin centres: bin, x, pdf, mu, sigma."""
    x = F.col(col).cast("double")
    st = scalars(df.agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma"),
                         F.min(x).alias("lo"), F.max(x).alias("hi")))
    mu, sigma, lo, hi = st["mu"], st["sigma"], st["lo"], st["hi"]
    h = histogram(df, col, bins)
    width = (hi - lo) / bins
    centre = lo + (F.col("bin") + 0.5) * width
    z = F.try_divide(centre - mu, sigma)  # null for a constant column
    return h.select("bin", rnd(centre).alias("x"),
                    F.round(F.try_divide(F.exp(-0.5 * z * z), sigma * math.sqrt(2 * math.pi)), places).alias("pdf"),
                    rnd(mu).alias("mu"), rnd(sigma).alias("sigma"))


def box_stats(df: DataFrame, col: str, by: str | None = None, k: float = 1.5,
              approx: bool = False) -> DataFrame:
    """L4: per group n, q1, median, q3, iqr, fences, whiskers (most extreme
    values inside the fences) and the number of outliers.  Two aggregations:
    quartiles per group, then the values beside their group's fences (a scalar
    subquery without groups, else as in ``exact_quantiles``)."""
    x = F.col(col).cast("double")
    keys = [by] if by else []
    few = few_groups(df, keys) if by else True
    if approx:
        q = df.groupBy(*keys).agg(F.count(x).alias("n"), _quantiles(x, (0.25, 0.5, 0.75), True).alias("q"))
    else:
        q = exact_quantiles(df, col, (0.25, 0.5, 0.75), by=keys, few=few)
    q = q.select(*keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                 F.col("q")[2].alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
         .withColumn("lower_fence", F.col("q1") - k * F.col("iqr")) \
         .withColumn("upper_fence", F.col("q3") + k * F.col("iqr"))
    values = df.select(*keys, x.alias("__x")).filter(F.col("__x").isNotNull())
    if by:
        joined = _beside(values, q, keys, few)
    else:
        s = scalars(q)
        joined = values.select("__x", *[s[c].alias(c) for c in q.columns])
    inside = (F.col("__x") >= F.col("lower_fence")) & (F.col("__x") <= F.col("upper_fence"))
    of_group = [c for c in q.columns if c not in keys]
    out = joined.groupBy(*keys).agg(*[F.first(c).alias(c) for c in of_group],
                                    F.min(F.when(inside, F.col("__x"))).alias("whisker_low"),
                                    F.max(F.when(inside, F.col("__x"))).alias("whisker_high"),
                                    F.count_if(~inside).alias("n_outliers")).filter(F.col("n") > 0)
    return out.select(*keys, "n", rnd("q1").alias("q1"), rnd("median").alias("median"), rnd("q3").alias("q3"),
                      rnd("iqr").alias("iqr"), rnd("lower_fence").alias("lower_fence"),
                      rnd("upper_fence").alias("upper_fence"), rnd("whisker_low").alias("whisker_low"),
                      rnd("whisker_high").alias("whisker_high"), "n_outliers")


# Names of the planned API.
missing = missing_shares
zeros = zero_shares
complete = completeness


def describe(df: DataFrame, cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """E9 + E10 (``describe(include='all')``): the numeric report and the
    text report of ``cols`` (default: all columns)."""
    cols = cols or df.columns
    nums = [c for c in numeric_columns(df) if c in cols]
    texts = [c for c in text_columns(df) if c in cols]
    return (describe_numeric(df, nums) if nums else None, describe_text(df, texts) if texts else None)
