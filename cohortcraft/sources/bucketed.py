"""The customer-period fact as a table bucketed by customer (F1, D2, D3, O1-O11 without a customer shuffle).

Rows of a customer always lie in the same bucket, also those of periods that
are appended later, so windows, joins and set operations on the customer read
bucket by bucket: Spark plans them without an exchange on the customer.  A
new period is shuffled once, when it is appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def _bucketed(cp: DataFrame, buckets: int):
    # dealt as the buckets are, so each append adds one sorted file per bucket
    return (cp.select("customer", "period", "revenue").repartition(buckets, "customer")
            .write.format("parquet").bucketBy(buckets, "customer").sortBy("customer", "period"))


def write_fact(cp: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write ``cp`` (customer, period, revenue) as the new bucketed ``table`` and return it as :func:`read_fact` does.

    ``path`` is a folder that all executors share; without one the table goes
    into the checkpoint folder.  About as many buckets as the table has
    128 MB of data, at least as many as cores.
    """
    spark = cp.sparkSession
    where = path or f"{checkpoint_dir(spark).rstrip('/')}/{table}"
    _bucketed(cp, buckets).option("path", where).saveAsTable(table)
    return read_fact(spark, table)


def bucket_count(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Num Buckets'").collect()
    if not rows:
        raise ValueError(f"{table} is not bucketed")
    return int(rows[0]["data_type"])


def append_periods(cp: DataFrame, table: str) -> None:
    """Add rows, of new periods or of old ones, to their buckets."""
    _bucketed(cp, bucket_count(cp.sparkSession, table)).mode("append").saveAsTable(table)


def read_fact(spark: SparkSession, table: str) -> DataFrame:
    """The fact at the (customer, period) grain; rows of a pair from several appends are added up inside its bucket."""
    return (spark.table(table).groupBy("customer", "period")
            .agg(F.sum("revenue").cast("decimal(28,2)").alias("revenue")))
