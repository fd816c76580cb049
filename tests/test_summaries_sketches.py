"""Stored summaries and sketches, masked and packed cross products: against pandas, numpy and the exact operators."""

import contextlib
import io
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortcraft.functions import linalg
from cohortcraft.operators import profile as P
from cohortcraft.operators import retention, sketches, summaries
from cohortcraft.sources import customer_period


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("simple")
    return buf.getvalue()


def _frame(n=3000, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(1e6, 3, n)
    return pd.DataFrame({
        "i": rng.integers(0, 9, n), "x": np.where(rng.random(n) < 0.1, np.nan, x), "heavy": np.where(rng.random(n) < 0.7, 0.0, rng.exponential(5, n)),
        "one": 4.0, "t": [None if k % 7 == 0 else f"v{k % 40}" for k in range(n)], "none": [None] * n})


SCHEMA = "i int, x double, heavy double, one double, t string, none double"


def _spark(spark, frame):
    rows = [tuple(None if pd.isna(v) else (int(v) if c == "i" else v) for c, v in zip(frame.columns, r)) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, SCHEMA)


def test_merged_summaries_describe_the_whole_table(spark):
    frame = _frame()
    parts = [_spark(spark, frame[a:b]) for a, b in ((0, 1), (1, 900), (900, 900), (900, 3000))]
    whole = _spark(spark, frame)
    merged = summaries.merged(*map(summaries.summarise, parts))
    for summary in (summaries.summarise(whole), merged):
        got = {r["column_name"]: r for r in summaries.described(summary, whole).collect()}
        assert [r["ordinal"] for r in sorted(got.values(), key=lambda r: r["ordinal"])] == list(range(1, 7))
        for c in ("i", "x", "heavy", "one"):
            v, r = frame[c].dropna().astype(float), got[c]
            assert (r["n_rows"], r["n_non_null"], r["n_missing"], r["n_zero"]) == (3000, len(v), 3000 - len(v), int((v == 0).sum()))
            assert (r["min"], r["max"]) == (v.min(), v.max())
            assert np.allclose([r["mean"], r["std"], r["q25"], r["q50"], r["q75"]],
                               [v.mean(), v.std(), *v.quantile([0.25, 0.5, 0.75])], atol=2e-6)
        assert got["t"]["n_non_null"] == frame["t"].notna().sum() and (got["t"]["min_text"], got["t"]["max_text"]) == ("v0", "v9")
        assert got["none"]["mean"] is None and got["none"]["q50"] is None and got["none"]["pct_missing"] == 100.0
        sketched = {r["column_name"]: r for r in summaries.described(summary).collect()}
        v = frame["x"].dropna()
        assert all(abs((v <= sketched["x"][c]).mean() - q) < summaries.RANK_ERROR for c, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))
        distinct = {r["column_name"]: r["distinct_estimate"] for r in summaries.distinct_estimates(summary).collect()}
        assert distinct["i"] == 9 and abs(distinct["t"] - 40) <= 1 and abs(distinct["x"] - v.nunique()) < 0.03 * v.nunique()


def test_summary_is_one_scan_and_an_empty_table_has_one(spark):
    whole = _spark(spark, _frame(50))
    folded = plan(summaries.summarise(whole))
    assert len(re.findall(r"Scan", folded.split("Initial Plan")[0])) == 1 and folded.count("Exchange") == 1
    empty = {r["column_name"]: r for r in summaries.described(summaries.summarise(whole.limit(0)), whole.limit(0)).collect()}
    assert all(r["n_rows"] == 0 and r["pct_missing"] is None and r["mean"] is None for r in empty.values())


def _fact(spark, n=40000, periods=4, seed=8):
    rng = np.random.default_rng(seed)
    rows = [(int(c), 2015 + p) for p in range(periods) for c in rng.choice(n, n // 2, replace=False)]
    return spark.createDataFrame(rows, "customer long, period int").withColumn("value", F.lit(1.0))


@pytest.mark.parametrize("lg,exact", [(16, True), (12, False)])
def test_sketched_changes_are_within_the_stated_error(spark, lg, exact):
    fact = _fact(spark)
    want = {r["year"]: r for r in retention.summary(customer_period(fact, "customer", "period", "value")).collect()}
    stored = sketches.period_sketches(fact.filter("period < 2017"), lg_nominal=lg)
    stored = sketches.merged(stored, sketches.period_sketches(fact.filter("period >= 2017 OR customer % 3 = 0"), lg_nominal=lg), lg)
    found = sketches.estimated_changes(stored, lg_nominal=lg).collect()
    assert [r["year"] for r in sorted(found, key=lambda r: r["year"])] == [2016, 2017, 2018]
    for r in found:
        w = want[r["year"]]
        pairs = [(r["total_customers"], w["total_customers"]), (r["new_customers"], w["new_customers"]),
                 (r["lost_customers"], w["lost_customers"]), (r["existing_customers"], w["existing_cust"])]
        assert (r["standard_error"] == 0.0) == exact
        assert all(abs(a - b) <= 4 * r["standard_error"] for a, b in pairs)


def test_sketches_shuffle_no_customer(spark):
    p = plan(sketches.period_sketches(_fact(spark, 200)))
    assert "hashpartitioning(customer" not in p and p.count("Exchange hashpartitioning(period") == 1


def test_sketches_of_odd_rows(spark):
    fact = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), ("b", None), (None, 3), ("b", 3)], "customer string, period int")
    row = sketches.estimated_changes(sketches.period_sketches(fact)).collect()
    assert [tuple(r) for r in row] == [(3, 1, 1, 1, 0, 0.0)]
    assert sketches.estimated_changes(sketches.period_sketches(fact.limit(0))).collect() == []


def test_correlations_with_nulls_equal_pandas(spark):
    rng = np.random.default_rng(6)
    n = 700
    a = rng.normal(1e7, 1, n)
    frame = pd.DataFrame({"a": a, "b": np.where(rng.random(n) < 0.3, np.nan, 2 * a + rng.normal(0, 1, n)),
                          "c": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n)), "one": 3.7, "none": np.nan})
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.to_numpy()]
    df = spark.createDataFrame(rows, "a double, b double, c double, one double, none double").repartition(5)
    want = frame.corr()
    for r in P.correlations(df, list(frame.columns)).collect():
        w = want.loc[r["var1"], r["var2"]]
        assert r["corr"] is None if np.isnan(w) else abs(r["corr"] - w) < 2e-6, r
    target = {r["column_name"]: r["corr"] for r in P.correlations(df, ["a", "c"], target="b").collect()}
    assert all(abs(target[c] - want.loc[c, "b"]) < 2e-6 for c in target)


def test_gram_rows_are_tasks_times_groups(spark):
    """Packed partial sums: one row per task and group is shuffled, never one per cell; equal to numpy."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 6))
    df = spark.createDataFrame([(i % 7, *map(float, r)) for i, r in enumerate(x)], "g int, " + ", ".join(f"c{i} double" for i in range(6))).repartition(6)
    cols = [f"c{i}" for i in range(6)]
    parts = linalg.partial_sums(df, cols, lambda b: (b.T @ b).ravel(), F.col("g"))
    assert parts.count() <= 6 * 7 and {len(r["v"]) for r in parts.collect()} == {36}
    got = linalg.grouped_gram(df, cols, "g", intercept=True)
    assert sorted(got) == list(range(7))
    for g, m in got.items():
        v = np.column_stack([np.ones(len(x)), x])[np.arange(900) % 7 == g]
        assert np.allclose(m, v.T @ v)
    with pytest.raises(ValueError):
        linalg.summed(parts, max_groups=6)
    nulls = df.withColumn("c0", F.when(F.col("c1") > 0, F.col("c0")))
    keep = x[:, 1] > 0
    assert np.allclose(linalg.grouped_gram(nulls, cols)[0], x[keep].T @ x[keep])
    assert linalg.grouped_gram(df.limit(0), cols) == {}


def test_correlations_compute_their_input_once(spark):
    """No pass before the sums looks for a shift; blocks of very different means, constants and columns without values."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rng = np.random.default_rng(7)
    a = np.repeat([1e8, -3e7, 5.0, 2e8], 300) + rng.normal(0, 1, 1200)
    frame = pd.DataFrame({"a": a, "b": a * 3 + rng.normal(0, 1e7, 1200), "c": np.where(np.arange(1200) < 600, np.nan, rng.normal(1e9, 1, 1200)),
                          "one": 0.1, "none": np.nan})
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.to_numpy()]
    df = spark.createDataFrame(rows, "a double, b double, c double, one double, none double").coalesce(4).mapInArrow(
        counted, "a double, b double, c double, one double, none double")
    got = P.correlations(df, list(frame.columns)).collect()
    assert seen.value == len(rows)
    want = frame.corr()
    for r in got:
        w = want.loc[r["var1"], r["var2"]]
        constant = "one" in (r["var1"], r["var2"]) or np.isnan(w)
        assert r["corr"] is None if constant else abs(r["corr"] - w) < 2e-6, r
