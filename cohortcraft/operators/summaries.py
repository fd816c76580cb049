"""Mergeable column summaries of a whole table (A5, E9, E11-E13, E18, E20) from one scan.

A summary is one row per column: counts, extremes, moments and sketches of
the quantiles (KLL) and of the distinct values (HLL).  It is made of one
aggregation over all columns, can be stored, and is extended by the
summary of new files without reading the old ones.  ``described`` turns it
into the usual report; quartiles are the sketch's (rank error below 0.1 %),
or exact when the rows are given: the sketch then brackets each quartile and
one further pass counts what lies inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import rnd
from .profile import bracketed_quantiles, dtype_family

#: Entries that a quantile sketch keeps per level, and a bound of its rank error (with a wide margin).
KLL_K, RANK_ERROR = 4096, 0.004
#: log2 of the buckets of a distinct-value sketch (standard error 0.8 %).
HLL_LG = 14
QUARTILES = (0.25, 0.5, 0.75)

SUMMARY = ("column_name string, ordinal int, dtype_family string, n_rows bigint, n_non_null bigint, n_zero bigint, min_value double, "
           "max_value double, min_text string, max_text string, mean double, m2 double, quantiles binary, distinct_values binary")


def _is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def _sortable(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))


def summarise(df: DataFrame) -> DataFrame:
    """One row per column of ``df`` (columns as in SUMMARY); one scan, one aggregation."""
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(df.schema.fields):
        x = F.col(f"`{f.name}`")
        number, text = x.cast("double"), x.cast("string")
        own: dict[str, Column] = {"n_non_null": F.count(x), "distinct_values": F.hll_sketch_agg(text, HLL_LG)}
        if _is_number(f):
            own |= {"n_zero": F.count_if(x == 0), "min_value": F.min(number), "max_value": F.max(number), "mean": F.avg(number),
                    "m2": F.var_pop(number) * F.count(x), "quantiles": F.kll_sketch_agg_double(number, KLL_K)}
        elif _sortable(f):
            own |= {"min_text": F.min(x).cast("string"), "max_text": F.max(x).cast("string")}
        aggs += [c.alias(f"{name}{i}") for name, c in own.items()]
        fields = []
        for part in T.StructType.fromDDL(SUMMARY).fields:
            value = {"column_name": F.lit(f.name), "ordinal": F.lit(i + 1), "dtype_family": F.lit(dtype_family(f.dataType)),
                     "n_rows": F.col("n")}.get(part.name)
            if value is None:
                value = F.col(f"{part.name}{i}") if part.name in own else F.lit(None)
            fields.append(value.cast(part.dataType).alias(part.name))
        rows.append(F.struct(*fields))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def merged(*summaries: DataFrame) -> DataFrame:
    """The summary of all rows behind ``summaries`` of tables with the same columns.

    Moments are merged about the common mean: m2 = sum(m2_i + n_i (mean_i - mean)^2).
    """
    every = summaries[0]
    for more in summaries[1:]:
        every = every.unionByName(more)
    of_column = Window.partitionBy("column_name")
    n, weighted = F.sum("n_non_null").over(of_column), F.sum(F.col("mean") * F.col("n_non_null")).over(of_column)
    common = every.withColumn("common", F.try_divide(weighted, n))
    off = F.col("mean") - F.col("common")
    return common.groupBy("column_name").agg(
        F.min("ordinal").alias("ordinal"), F.first("dtype_family").alias("dtype_family"), F.sum("n_rows").alias("n_rows"),
        F.sum("n_non_null").alias("n_non_null"), F.sum("n_zero").alias("n_zero"), F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"), F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text"),
        F.max("common").alias("mean"), F.sum(F.col("m2") + F.col("n_non_null") * off * off).alias("m2"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct_values").alias("distinct_values")).select(*[f.name for f in T.StructType.fromDDL(SUMMARY).fields])


def _edges(p: float) -> list[float]:
    return [max(0.0, p - RANK_ERROR), min(1.0, p + RANK_ERROR)]


def described(summary: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per column: shape, missing and zero shares, moments, quartiles and extremes, in table order (``ordinal``).

    ``rows``, the table behind the summary, makes the quartiles exact: its
    numeric columns are read once more.  Numbers are NULL for columns of
    other types; ``min_text`` and ``max_text`` are theirs.
    """
    has_values = F.col("dtype_family").isin("integer", "float") & (F.col("n_non_null") > 0)  # an empty sketch has no quantiles

    def quantile(p: float) -> Column:
        return F.kll_sketch_get_quantile_double(F.when(has_values, F.col("quantiles")), F.lit(p))

    report = summary.withColumn("q", F.when(has_values, F.array(*map(quantile, QUARTILES))))
    if rows is not None:
        cols = [f.name for f in rows.schema.fields if _is_number(f)]
        brackets = summary.filter(has_values).select(
            "column_name", F.array(*(quantile(e) for p in QUARTILES for e in _edges(p))).alias("__b"))
        long = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("__x"))
                                              for c in cols)))).filter("__x IS NOT NULL")
        # one row per column: bounded by the schema, not by the data
        exact = bracketed_quantiles(long.join(F.broadcast(brackets), "column_name"), QUARTILES, ["column_name"])
        report = report.drop("q").join(F.broadcast(exact.select("column_name", "q")), "column_name", "left")
    share = lambda c: rnd(F.try_divide(F.col(c) * F.lit(100.0), F.col("n_rows")))
    return report.select(
        "column_name", "ordinal", "dtype_family", "n_rows", "n_non_null", (F.col("n_rows") - F.col("n_non_null")).alias("n_missing"),
        rnd(F.try_divide((F.col("n_rows") - F.col("n_non_null")) * 100.0, F.col("n_rows"))).alias("pct_missing"),
        "n_zero", share("n_zero").alias("pct_zero"), rnd("mean").alias("mean"),
        rnd(F.sqrt(F.try_divide(F.col("m2"), F.when(F.col("n_non_null") > 1, F.col("n_non_null") - 1)))).alias("std"),
        F.col("min_value").alias("min"), *(rnd(F.col("q")[i]).alias(name) for i, name in enumerate(("q25", "q50", "q75"))),
        F.col("max_value").alias("max"), "min_text", "max_text")


def distinct_estimates(summary: DataFrame) -> DataFrame:
    """column_name, distinct_estimate: from the sketch, with a standard error of about 0.8 %."""
    return summary.select("column_name", F.hll_sketch_estimate("distinct_values").alias("distinct_estimate"))
