"""Profiling and cleaning: the literal cases of FIXTURES §3 and traps T1-T5."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from cohortcraft.functions.expr import bucket_hash, safe_ratio
from cohortcraft.operators import clean as C
from cohortcraft.operators import profile as P
from cohortcraft.sources import nan_to_null


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([(3,), (3,), (1,), (1,), (2,), (None,)], "x int")
    assert df.select(P.mode_value(df, "x").alias("m")).first()["m"] == 1
    assert {r["column_name"]: r["mode"] for r in P.modes(df, ["x"]).collect()} == {"x": "1"}
    filled = C.impute_mode(df, ["x"]).agg(F.count_if(F.col("x") == 1)).first()[0]
    assert filled == 3


def test_exact_quartiles_not_summary(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    d = P.describe_numeric(df, ["x"]).first()
    assert (d["q25"], d["q50"], d["q75"]) == (1.75, 2.5, 4.75)
    f = P.iqr_fence(df, "x").first()
    assert f["iqr"] == 3.0 and f["upper"] == 9.25 and f["lower"] == -2.75


def test_safe_ratio(spark):
    df = spark.createDataFrame([(0, 0), (3, 0), (3, 4)], "a int, b int")
    assert [r[0] for r in df.select(safe_ratio("a", "b")).collect()] == [0.0, 0.0, 0.75]


def test_nan_is_null_before_comparison(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (12.0,)], "x double"))
    got = [r["x1"] for r in C.binarize_column(df, "x", 10).collect()]
    assert got == [0, 1]


def test_constant_column_corr_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    c = {(r["var1"], r["var2"]): r["corr"] for r in P.correlations(df, ["a", "b"]).collect()}
    assert c[("a", "b")] is None and c[("b", "b")] == 1.0


def test_missing_zero_and_completeness(spark):
    df = spark.createDataFrame([(0, None), (1, "x"), (0, "y"), (None, "z")], "a int, s string")
    miss = {r["column_name"]: r for r in P.missing_shares(df).collect()}
    assert miss["a"]["pct_missing"] == 25.0 and miss["s"]["n_missing"] == 1
    z = P.zero_shares(df, ["a"]).first()
    assert z["zero_pct"] == 50.0 and z["nonzero_pct"] == 50.0      # NULL counts as non-zero
    assert P.zero_counts(df, ["a"]).first()["n_zero"] == 2
    assert P.completeness(df).first()["complete"] is False
    assert P.completeness(df.na.drop()).first()["complete"] is True


def test_value_counts_and_top_values(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("a",), (None,)], "v string")
    vc = {r["value"]: r for r in P.value_counts(df, ["v"], normalize=True).collect()}
    assert vc["b"]["n"] == 2 and vc["c"]["pct"] == 20.0 and None not in vc
    top = [r["value"] for r in P.top_values(df, ["v"], 2).orderBy("rank").collect()]
    assert top == ["a", "b"]                       # tie on count -> smaller value first
    t = P.describe_text(df, ["v"]).first()
    assert (t["count"], t["unique"], t["top"], t["freq"]) == (5, 3, "a", 2)


def test_histogram_box_density(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)] + [(100.0,)], "x double")
    h = {r["bin"]: r["n"] for r in P.histogram(df, "x", 10).collect()}
    assert sum(h.values()) == 12 and h[9] == 1      # the max falls in the last bin
    b = P.box_stats(df, "x").first()
    assert b["n_outliers"] == 1 and b["whisker_high"] == 10.0 and b["whisker_low"] == 0.0
    d = sorted(P.density(df, "x", grid=50, bins=2000).collect(), key=lambda r: r["point"])
    xs = [float(x) for x in range(11)] + [100.0]
    n = len(xs)
    mean = sum(xs) / n
    sd = math.sqrt(sum((v - mean) ** 2 for v in xs) / (n - 1))
    h = sd * n ** -0.2                                   # Scott's rule
    for r in d:
        exact = sum(math.exp(-0.5 * ((r["x"] - v) / h) ** 2) for v in xs) / (n * h * math.sqrt(2 * math.pi))
        # binned estimate: points move at most half a bin (here 0.025 vs h ~ 16)
        assert abs(r["density"] - exact) < 1e-2 * max(exact, 1e-6)


def test_empty_bins_and_constant_columns(spark):
    sparse = P.histogram(spark.createDataFrame([(0.0,), (1.0,), (100.0,)], "x double"), "x", 50).collect()
    assert len(sparse) == 50 and sum(r["n"] for r in sparse) == 3 and sum(r["n"] == 0 for r in sparse) == 48
    same = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert {r["pdf"] for r in P.normal_fit(same, "x", 4).collect()} == {None}
    assert {r["density"] for r in P.density(same, "x", 4).collect()} == {None}
    assert P.histogram(same.filter("x < 0"), "x", 4).count() == 0


def test_cleaning_steps(spark):
    df = spark.createDataFrame([("individual", 10.0, 20.0), ("joint", 10.0, 20.0), (None, 10.0, 20.0)],
                               "application_type string, annual_income double, annual_income_joint double")
    got = [r["annual_income"] for r in C.resolve_pairs(df, "application_type", "individual",
                                                       ["annual_income"], ["annual_income_joint"]).collect()]
    assert got == [10.0, 20.0, 20.0]
    out = spark.createDataFrame([(1.0,), (2e6,), (None,)], "annual_income double")
    assert C.remove_outliers(out, "annual_income", C.INCOME_MAX).count() == 1
    z = spark.createDataFrame([(0, 1), (0, 0), (0, 2), (1, 3)], "a int, b int")
    assert C.drop_mostly_zero(z, ["a", "b"], threshold_pct=70).columns == ["b"]


def test_bucket_hash_matches_md5_prefix(spark):
    import hashlib
    key = "1-2-3-4"
    want = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % 100
    assert spark.range(1).select(bucket_hash(F.lit(key)).alias("h")).first()["h"] == want


def test_table_profile(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (None, None, 2.5)], "i int, s string, d double")
    p = {r["column_name"]: r for r in P.table_profile(df).collect()}
    assert p["i"]["dtype_family"] == "integer" and p["s"]["n_non_null"] == 1 and p["d"]["n_rows"] == 2
    assert P.numeric_columns(df) == ["i", "d"] and P.text_columns(df) == ["s"]
    assert math.isclose(P.means_by(df.fillna(0), "i", ["d"]).count(), 2)


def test_exact_quantiles_match_numpy_with_small_sketch(spark):
    import numpy as np
    rng = np.random.default_rng(11)
    vals = np.round(rng.lognormal(3, 1, size=3000), 1)       # many ties
    groups = rng.integers(0, 3, size=3000)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, vals)], "g int, x double")
    probs = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    # accuracy 200: the sketch alone would be off by up to 1/200 in rank
    got = {r["g"]: r["q"] for r in P.exact_quantiles(df, "x", probs, by=["g"], accuracy=200).collect()}
    for g in range(3):
        want = np.quantile(vals[groups == g], probs)          # linear interpolation
        assert np.allclose(got[g], want, rtol=0, atol=1e-9)
    one = P.exact_quantiles(df, "x", (0.5,), accuracy=100).first()
    assert abs(one["q"][0] - np.quantile(vals, 0.5)) < 1e-9 and one["n"] == 3000


def test_exact_quantiles_small_groups_fine_sketch(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    rows, want = [], {}
    probs = (0.1, 0.25, 0.5, 0.75, 0.9)
    for g, n in enumerate([1, 2, 3, 7, 100, 2286]):
        v = rng.normal(size=n).round(3)
        rows += [(g, float(x)) for x in v]
        want[g] = np.quantile(v, probs)
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r["g"]: r["q"] for r in P.exact_quantiles(df, "x", probs, by=["g"]).collect()}
    for g, w in want.items():
        assert np.allclose(got[g], w, atol=1e-9), g


@pytest.mark.parametrize("accuracy", [1_000_000, 50])
@pytest.mark.parametrize("values", [2, 1_000_000], ids=["tied", "spread"])
def test_exact_quantiles_with_ties_and_groups(spark, values, accuracy):
    v = np.random.default_rng(7).integers(0, values, 20_000).astype(float)
    df = spark.createDataFrame([(float(x), i % 3) for i, x in enumerate(v)], "x double, g int").repartition(4)
    probs = (0, 0.1, 0.25, 0.5, 0.75, 1)
    assert np.allclose(P.exact_quantiles(df, "x", probs, accuracy=accuracy).first()["q"], np.quantile(v, probs))
    for few in (None, False):  # broadcast group rows, or a shuffled join beyond their bound
        for r in P.exact_quantiles(df, "x", probs, by=["g"], accuracy=accuracy, few=few).collect():
            assert np.allclose(r["q"], np.quantile(v[r["g"]::3], probs))


def test_modes_of_columns_of_different_types(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "b"), (2, "a"), (None, None)], "x int, y string")
    assert P.mode_row(df, ["x", "y"]).first().asDict() == {"x": 1, "y": "a"}
    assert C.impute_mode(df, ["x", "y"]).filter("x is null or y is null").count() == 0
