"""Feature preparation and models: FIXTURES §3 (unseen category, encode
order, ridge against the numpy closed form) and §5 properties."""

import contextlib
import io
import os

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from conftest import SF001
from cohortcraft.operators import features as M
from cohortcraft.operators import models as N


def test_encode_order_is_byte_order(spark):
    df = spark.createDataFrame([("b",), ("B",), ("a",), ("é",)], "c string")
    enc = M.fit_encode(df, ["c"], bound=4)
    assert enc.labels["c"] == ["B", "a", "b", "é"]
    got = {r["orig"]: r["c"] for r in enc.transform(df.withColumn("orig", F.col("c"))).collect()}
    assert got == {"B": 0, "a": 1, "b": 2, "é": 3}


def test_unseen_category_goes_to_other_then_extra_code(spark):
    train = spark.createDataFrame([("x",), ("x",), ("y",)], "c string")
    test = spark.createDataFrame([("z",)], "c string")
    shr = M.fit_shrink(train, ["c"], top=15)
    assert shr.transform(test).first()["c"] == "other"
    enc = M.fit_encode(shr.transform(train), ["c"])      # 'other' never seen in training
    assert enc.transform(shr.transform(test)).first()["c"] == 2


def test_standardize_population_std_and_zero_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "a double, k double")
    st = M.fit_standardize(df, ["a", "k"])
    out = st.transform(df)
    a = np.array([r["a"] for r in out.collect()])
    assert abs(a.mean()) < 1e-12 and abs(a.std() - 1) < 1e-12       # population std
    assert {r["k"] for r in out.collect()} == {0.0}                     # constant -> 0


def test_split_disjoint_complete(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("loan_id"))
    s = M.split(df)
    n_test = s.filter("is_test").count()
    assert s.count() == 2000 and 300 < n_test < 500
    assert s.filter(F.col("is_test").isNull()).count() == 0


def test_ridge_matches_numpy_closed_form(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(200, 3))
    y = X @ np.array([1.5, -2.0, 0.5]) + 3 + rng.normal(scale=0.3, size=200)
    rows = [(str(i), *map(float, X[i]), float(y[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double, y double")
    g = N.gram_by(df, ["a", "b", "c"], "y", F.lit(0))
    m = N.ridge_from_gram(g[0], 10.0, ["a", "b", "c"])
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 10 * np.eye(3), Xc.T @ yc)
    assert np.allclose(m.coef, w, atol=1e-9) and abs(m.intercept - (y.mean() - X.mean(0) @ w)) < 1e-9
    pred = m.transform(df)
    met = N.metrics(pred, "y").first()
    resid = y - (m.intercept + X @ m.coef)
    assert abs(met["rmse"] - np.sqrt(np.mean(resid ** 2))) < 1e-9
    assert abs(met["r2"] - (1 - np.sum(resid ** 2) / np.sum((y - y.mean()) ** 2))) < 1e-9
    cv = N.ridge_cv(df, ["a", "b", "c"], "y", "k")
    assert cv.model.alpha in N.RIDGE_ALPHAS and len(cv.cv) == 3
    # the CV choice equals a brute-force refit per fold
    folds = {r["k"]: r["f"] for r in df.select("k", N.fold_of("k").alias("f")).collect()}
    fa = np.array([folds[str(i)] for i in range(200)])
    for alpha, score in cv.cv:
        r2s = []
        for f in sorted(set(fa)):
            tr, te = fa != f, fa == f
            Xt, yt = X[tr], y[tr]
            wt = np.linalg.solve((Xt - Xt.mean(0)).T @ (Xt - Xt.mean(0)) + alpha * np.eye(3),
                                 (Xt - Xt.mean(0)).T @ (yt - yt.mean()))
            bt = yt.mean() - Xt.mean(0) @ wt
            r = y[te] - (bt + X[te] @ wt)
            r2s.append(1 - np.sum(r ** 2) / np.sum((y[te] - y[te].mean()) ** 2))
        assert abs(np.mean(r2s) - score) < 1e-9


def test_learning_curve_grows(spark):
    rng = np.random.default_rng(3)
    rows = [(str(i), float(x), float(2 * x + rng.normal())) for i, x in enumerate(rng.normal(size=400))]
    df = M.split(spark.createDataFrame(rows, "loan_id string, a double, y double"))
    curve = N.learning_curve(df, ["a"], "y", "loan_id", "is_test", (1.0,))
    ns = [c[0] for c in curve]
    assert ns == sorted(ns) and ns[-1] == df.filter(~F.col("is_test")).count()
    assert all(c[1] > 0 and c[2] > 0 for c in curve)


def test_small_tree_models_fit(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(300, 2))
    y = np.where(X[:, 0] > 0, 3.0, -3.0) + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(X, y)], "a double, b double, label double")
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    for est in (N.forest(numTrees=5, maxDepth=3), N.gbt(maxIter=5)):
        model = est.fit(data)
        r2 = N.metrics(model.transform(data), "label").first()["r2"]
        assert r2 > 0.9
        imp = N.importances(model, ["a", "b"])
        assert imp[-1][0] == "a"


@pytest.mark.skipif(not os.path.exists(SF001), reason="test data")
def test_prepared_loans_sf0001(spark):
    from cohortcraft.sources import loan_like
    p = M.prepare_loans(loan_like(spark, SF001))
    assert set(p.numericals) | set(p.categoricals) == set(p.features)
    assert "loan_id" not in p.features and "split_bucket" not in p.features
    train = p.df.filter(~F.col("is_test"))
    for c in p.numericals:
        st = train.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).first()
        assert abs(st["m"]) < 1e-9 and (st["s"] == 0 or abs(st["s"] - 1) < 1e-9)
    for c in p.categoricals:
        assert p.df.agg(F.max(c)).first()[0] <= 15
    assert p.df.select([F.count_if(F.col(c).isNull()) for c in p.features]).first() == tuple([0] * len(p.features))


def test_tree_learning_curve(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(400, 2))
    y = np.where(X[:, 0] > 0, 2.0, -2.0) + 0.1 * rng.normal(size=400)
    df = M.split(spark.createDataFrame([(str(i), float(a), float(b), float(t)) for i, ((a, b), t)
                                        in enumerate(zip(X, y))], "loan_id string, a double, b double, label double"))
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    curve = N.tree_learning_curve(N.forest(numTrees=3, maxDepth=3), data, "loan_id", "is_test", sizes=3)
    assert len(curve) == 3 and curve[0][0] < curve[1][0] < curve[2][0]
    assert curve[-1][0] == df.filter(~F.col("is_test")).count()


def test_table_encoder_matches_literal_encoder(spark):
    df = spark.createDataFrame([(1, "b", 0), (2, "B", 0), (3, "a", 0), (4, "é", 0), (5, "a", 0), (6, None, 0)], "k int, c string, z int")
    bounded, table = M.fit_encode(df, ["c"], bound=4), M.fit_encode(df, ["c"])
    assert isinstance(table, M.TableEncoder)
    codes = [[r["c"] for r in e.transform(df).orderBy("k").collect()] for e in (bounded, table)]
    assert codes[0] == codes[1] == [2, 0, 1, 3, 1, 4]
    assert table.transform(df).columns == ["k", "c", "z"]


def test_every_code_of_many_labels(spark):
    df = spark.range(20000).select(F.xxhash64("id").cast("string").alias("v"), F.col("id").alias("k"))
    got = {r["k"]: r["v"] for r in M.fit_encode(df, ["v"]).transform(df).collect()}
    names = {r["k"]: r["v"] for r in df.collect()}
    rank = {v: i for i, v in enumerate(sorted(names.values()))}
    assert all(got[k] == rank[v] for k, v in names.items())


def test_distributed_codes_match_sorted_order(spark):
    vals = [f"v{i:04d}" for i in range(500)] + ["B", "a", "é"]
    rows = [("x", v) for v in vals] + [("y", v) for v in vals[:37]]
    d = spark.createDataFrame(rows, "column_name string, value string")
    got = {(r["column_name"], r["value"]): r["code"] for r in M.distributed_codes(d).collect()}
    for col, vs in (("x", vals), ("y", vals[:37])):
        for i, v in enumerate(sorted(vs, key=lambda s: s.encode("utf-8"))):
            assert got[(col, v)] == i


def _noisy(spark, n=240, seed=11):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 3))
    y = X @ [1.0, -2.0, 0.5] + np.where(X[:, 0] > 0, 2.0, 0.0) + rng.normal(size=n)
    df = spark.createDataFrame([(f"k{i}", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(X, y))],
                               "loan_id string, a double, b double, c double, label double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache()


def test_grid_sizes_equal_separate_fits(spark):
    """Every size of a nested ensemble scores as an ensemble fitted with that size."""
    data = _noisy(spark)
    fold = N.bucket_hash("loan_id", 100) % 2
    for est, grid, sized in ((N.gbt(), {"maxIter": [6, 2], "maxDepth": [2, 3]}, "maxIter"),
                             (N.forest(bootstrap=False), {"numTrees": [1, 3], "maxDepth": [2, 4]}, "numTrees")):
        table = N.grid_search(est, grid, data, "loan_id", folds=2)
        assert len(table) == 4
        for params, score in table:
            r2s = [N.metrics(est.fit(data.filter(fold != f), {est.getParam(k): v for k, v in params.items()})
                             .transform(data.filter(fold == f)), "label").first()["r2"] for f in range(2)]
            assert abs(score - np.mean(r2s)) < 1e-9, params
    # a bootstrapped forest: the last size is the fitted model itself, the others the means of its first trees
    model = N.forest(numTrees=5, maxDepth=4).fit(data)
    staged = {r["n_trees"]: r for r in N.staged_scores(model, data, "label", [2, 5]).collect()}
    whole = N.metrics(model.transform(data), "label").first()
    assert abs(staged[5]["r2"] - whole["r2"]) < 1e-9 and abs(staged[5]["rmse"] - whole["rmse"]) < 1e-9
    rows = data.select("features", "label").collect()
    first = [np.mean([t.predict(r["features"]) for t in model.trees[:2]]) for r in rows]
    assert abs(staged[2]["rmse"] - np.sqrt(np.mean([(p - r["label"]) ** 2 for p, r in zip(first, rows)]))) < 1e-9


def test_every_prefix_chooses_its_own_penalty(spark):
    """The curve against refits of each prefix, fold and penalty on the rows themselves."""
    rng = np.random.default_rng(21)
    n, names = 400, [f"f{i}" for i in range(12)]
    X = rng.normal(size=(n, 12))
    y = X @ rng.normal(size=12) * 0.3 + 3 * rng.normal(size=n)
    df = M.split(spark.createDataFrame([(f"k{i}", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(X, y))],
                                       ", ".join(["loan_id string", *(f"{c} double" for c in names), "y double"])))
    rows = df.withColumn("b", N.bucket_hash("loan_id", 100)).collect()
    x = np.array([[r[c] for c in names] for r in rows])
    t, b, test = (np.array([r[c] for r in rows]) for c in ("y", "b", "is_test"))

    def fitted(keep, alpha):
        mx, my = x[keep].mean(0), t[keep].mean()
        xc = x[keep] - mx
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(12), xc.T @ (t[keep] - my))
        return lambda at: (x[at] - mx) @ w + my

    alphas = (0.1, 10.0, 1000.0)
    want = []
    for last in sorted(set(b[~test])):
        keep = ~test & (b <= last)
        if keep.sum() < 2:
            continue
        means = []
        for alpha in alphas:
            r2s = []
            for f in sorted(set(b[keep] % 10)):
                out, held = keep & (b % 10 != f), keep & (b % 10 == f)
                sst = ((t[held] - t[held].mean()) ** 2).sum()
                if out.sum() >= 2 and sst > 0:
                    r2s.append(1 - ((t[held] - fitted(out, alpha)(held)) ** 2).sum() / sst)
            means.append(np.mean(r2s) if r2s else 0.0)
        alpha = alphas[int(np.argmax(means))]
        predict = fitted(keep, alpha)
        want.append((int(keep.sum()), np.sqrt(np.mean((t[keep] - predict(keep)) ** 2)), np.sqrt(np.mean((t[test] - predict(test)) ** 2)), alpha))
    got = N.learning_curve(df, names, "y", "loan_id", "is_test", alphas)
    assert len({a for *_, a in got}) > 1
    assert np.allclose(got, want, rtol=1e-7)


@pytest.mark.skipif(not os.path.exists(SF001), reason="test data")
def test_one_fit_pass_equals_separate_fits(spark):
    """Modes, moments and top values from one scan are those of fits on rows whose modes were filled in before."""
    from cohortcraft.sources import loan_like
    raw = loan_like(spark, SF001)
    p = M.prepare_loans(raw)
    df = M.cleaned_split(raw).cache()
    train = df.filter(~F.col("is_test"))
    std, shr = M.fit_standardize(train, p.numericals), M.fit_shrink(train, p.categoricals)
    assert p.standardizer.n_rows == std.n_rows and p.shrinker.tops == shr.tops and p.shrinker.kept == shr.kept
    for c in p.numericals:
        assert np.isclose(p.standardizer.means[c], std.means[c], rtol=1e-12) and np.isclose(p.standardizer.stds[c], std.stds[c], rtol=1e-9)
    want = M.encoder_after_shrink(shr, std.n_rows).transform(shr.transform(std.transform(df))).select(*p.df.columns)
    one, other = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()) for d in (p.df, want))
    assert one == other
    df.unpersist()


def test_fit_statistics_is_one_scan_with_ties_and_empty_columns(spark):
    rows = [(1.0, 2, "b", False), (3.0, 1, "a", False), (None, None, None, False), (5.0, 2, "a", True), (7.0, 1, "b", True)]
    df = spark.createDataFrame(rows, "x double, k int, c string, is_test boolean")
    stats = M.fit_statistics(df, ["x", "k"], ["c"], ["k", "c"])
    modes, std, shr = M.fitted_from(stats, ["x", "k"], ["c"], ["k", "c"])
    assert modes == {"k": "1", "c": "a"} and std.n_rows == 3
    assert std.means == {"x": 2.0, "k": 4 / 3} and np.isclose(std.stds["k"], np.std([2, 1, 1])) and std.stds["x"] == 1.0
    assert shr.tops == {"c": ["a", "b"]} and shr.kept == {"c": 3}
    empty = M.fitted_from(M.fit_statistics(df.limit(0), ["x", "k"], ["c"], ["k", "c"]), ["x", "k"], ["c"], ["k", "c"])
    assert empty[0] == {"k": None, "c": None} and empty[1].stds == {"x": 0.0, "k": 0.0} and empty[2].tops == {"c": []}


@pytest.mark.skipif(not os.path.exists(SF001), reason="test data")
def test_shrunk_and_top_categories_compute_the_loans_once(spark):
    from cohortcraft.plans import registry
    from cohortcraft.sources import loan_like

    raw = loan_like(spark, SF001).cache()
    rows = raw.count()
    for query in (registry._shrunk, registry._top_categories):
        seen = spark.sparkContext.accumulator(0)

        def counted(batches, seen=seen):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        assert query(raw.mapInArrow(counted, raw.schema)).collect() and seen.value == rows
    raw.unpersist()


def test_moments_are_not_carried_along_with_every_value(spark):
    df = spark.createDataFrame([(1.0, "a", False)], "x double, c string, is_test boolean")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        M.fit_statistics(df, ["x"], ["c"], []).explain("simple")
    by_value = [line for line in buf.getvalue().splitlines() if "HashAggregate(keys=[column_name" in line]
    assert by_value and not any("avg" in line for line in by_value)


@pytest.mark.skipif(not os.path.exists(SF001), reason="test data")
def test_rows_of_a_training_partition_are_bounded(spark, monkeypatch):
    from cohortcraft.plans import loan_models as LM
    from cohortcraft.sources import loan_like

    monkeypatch.setattr(LM, "ROWS_PER_PARTITION", 100)
    p = M.prepare_loans(loan_like(spark, SF001))
    data = LM._assembled(p, ["sub_grade"])
    sizes = data.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == p.df.count() and max(sizes) < 200


def test_tree_settings_fit_an_executor():
    """Every task holds its own histograms, so four tasks stay near 1 GB; shallow boosting keeps no table of node ids."""
    assert 4 * N.forest().getMaxMemoryInMB() <= 1024 and N.forest().getCacheNodeIds()
    assert not N.gbt().getCacheNodeIds()
