"""A1, A2, A4: typed CSV scan, index-column drop, NaN as NULL, preview."""

from pyspark.sql import functions as F

from cohortcraft.sources import customer_period, preview, read_table


def test_csv_with_pandas_index_column(spark, tmp_path):
    p = tmp_path / "casestudy.csv"
    p.write_text(",customer_email,net_revenue,year\n0,a@x,10.5,2015\n1,b@x,NaN,2015\n2,a@x,3.25,2016\n")
    schema = "_c0 int, customer_email string, net_revenue double, year int"
    df = read_table(spark, str(p), schema=schema, index_col=True)
    assert df.columns == ["customer_email", "net_revenue", "year"]
    assert df.filter(F.col("net_revenue").isNull()).count() == 1      # NaN became NULL
    cp = customer_period(df, "customer_email", "year", "net_revenue")
    got = {(r["customer"], r["period"]): float(r["revenue"]) if r["revenue"] is not None else None
           for r in cp.collect()}
    assert got[("a@x", 2015)] == 10.5 and got[("b@x", 2015)] is None


def test_preview_is_ordered(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    assert [r["id"] for r in preview(df, 5, ["id"]).collect()] == [0, 1, 2, 3, 4]


def test_spread_only_when_fewer_partitions_than_cores(spark):
    from cohortcraft.sources import spread
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == cores
    many = spark.range(100).repartition(cores + 3)
    same = spread(many)
    assert same.rdd.getNumPartitions() == cores + 3
    assert same is many                      # unchanged: no shuffle added
    assert sorted(r[0] for r in spread(one).collect()) == list(range(100))
