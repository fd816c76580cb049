"""Scans (A1, A2), previews (A4) and the test-table reader.

Every scan states its schema when it can: inference costs an extra pass
over the input and is not stable between files.  Parquet carries its own
schema, so only CSV needs one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")

# Spark's name for a column whose CSV header cell is blank (pandas' index column).
BLANK_HEADER_COLUMN = "_c0"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn floating NaN into NULL.

    Spark orders NaN above every number (``NaN >= 10`` is true) while the
    pandas code this library reproduces treats NaN as missing; converting at
    the source keeps every later comparison, fill and aggregate on SQL NULL
    semantics.  Pure projection, fused into the scan's codegen stage.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            cols.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str | None = None, index_col: bool = False) -> DataFrame:
    """A1/A2: read a table.

    ``fmt`` defaults from the extension (``csv`` or ``parquet``).  For CSV the
    header row is used and ``schema`` should be given; ``index_col=True``
    drops the blank-header row-id column that a pandas export writes first.
    Floating NaN becomes NULL (see ``nan_to_null``).
    """
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    if fmt == "csv":
        reader = spark.read.option("header", True).option("mode", "FAILFAST")
        if schema is not None:
            reader = reader.schema(schema)
        else:
            reader = reader.option("inferSchema", True)
        df = reader.csv(path)
    else:
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.format(fmt).load(path)
    if index_col and BLANK_HEADER_COLUMN in df.columns:
        df = df.drop(BLANK_HEADER_COLUMN)
    return nan_to_null(df)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Repartition a scan that has fewer partitions than the cluster has
    cores (a file written as one parquet row group is read by one task, and
    broadcast joins would keep all following work in that task).  Local
    sessions only: a cluster's inputs are returned unchanged, however few
    splits they have, so nothing large is shuffled whole."""
    try:  # needs the classic API (not available under Spark Connect)
        sc = df.sparkSession.sparkContext
        if not sc.master.startswith("local"):
            return df
        target = min_partitions or sc.defaultParallelism
        if df.rdd.getNumPartitions() >= target:
            return df
    except Exception:  # noqa: BLE001
        return df
    return df.repartition(target)


def test_table(spark: SparkSession, sf_dir: str, name: str, min_partitions: int | None = None) -> DataFrame:
    """One of the driver's parquet tables, NaN as NULL, spread over the cores of a local session (``spread``)."""
    return spread(nan_to_null(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")), min_partitions)


def register_test_views(spark: SparkSession, sf_dir: str, names=TEST_TABLES) -> None:
    """Register the driver's tables as temp views (for SQL users)."""
    for n in names:
        test_table(spark, sf_dir, n).createOrReplaceTempView(n)


def preview(df: DataFrame, n: int = 5, order_by: list[str | Column] | None = None) -> DataFrame:
    """A4: first ``n`` rows.  Spark has no row order, so give ``order_by``
    for a reproducible preview; without it any ``n`` rows come back."""
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(n)
