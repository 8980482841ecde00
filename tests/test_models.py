import numpy as np
import pytest
from pyspark.sql import functions as F

from areapulse.operators import modelling as m
from areapulse.operators import reshape
from areapulse.plans.nowcast import nowcast

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 4)) * [1, 5, 0.3, 2] + [0, 3, 1, -2]
    y = 4 * x[:, 0] - 1.5 * x[:, 1] + rng.normal(size=120) * 0.5 + 10
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double")


def nipals(x, y, k, scale):
    """Plain NIPALS on the rows, as the check of the moment form."""
    xm, ym = x.mean(0), y.mean()
    xs, ys = (x.std(0, ddof=1), y.std(ddof=1)) if scale else (np.ones(x.shape[1]), 1.0)
    e, f = (x - xm) / xs, (y - ym) / ys
    fitted = np.zeros(len(y))
    for _ in range(k):
        w = e.T @ f
        w /= np.linalg.norm(w)
        t = e @ w
        p, q = e.T @ t / (t @ t), f @ t / (t @ t)
        fitted += q * t
        e, f = e - np.outer(t, p), f - q * t
    return fitted * ys + ym


@pytest.mark.parametrize("k,scale", [(1, True), (2, True), (3, False), (4, True)])
def test_pls_equals_nipals(planted, k, scale):
    x, y, df = planted
    model = m.pls_regression(df, NAMES, "y", k, scale)
    got = np.array([r["p"] for r in df.orderBy("id").select(model.score().alias("p")).collect()])
    assert np.allclose(got, nipals(x, y, k, scale), atol=1e-8)


def test_pls_component_choice_equals_refitting(planted):
    x, y, df = planted
    folded = m.fold_assign(df, "id", 5)
    got = {r["components"]: r["mse"] for r in m.pls_select_components(folded, NAMES, "y", "fold").collect()}
    fold = np.repeat(np.arange(5), 24)
    for k, mse in got.items():
        errors = []
        for f in range(5):
            train, held = fold != f, fold == f
            model = m.pls_from_moments(_moments(x[train], y[train]), NAMES, k, False)
            errors.append(np.mean((y[held] - x[held] @ np.array(model.weights) - model.intercept) ** 2))
        assert mse == pytest.approx(np.mean(errors), rel=1e-8)


def _moments(x, y):
    z = np.column_stack([x, y])
    return m.Moments(float(len(y)), z.sum(0), z.T @ z)


def test_folds_are_contiguous(spark):
    for n, sizes in ((32, [7, 7, 6, 6, 6]), (64, [13, 13, 13, 13, 12]), (3, [1, 1, 1])):
        rows = m.fold_assign(spark.range(n), "id", 5).orderBy("id").collect()
        folds = [r["fold"] for r in rows]
        assert folds == sorted(folds) and [folds.count(f) for f in sorted(set(folds))] == sizes


def test_scaler_population_and_constant_feature(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    got = [tuple(r) for r in m.standardize(df, df, ["x", "k"]).collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0)]


def descent(gram, cross, alpha):
    """Plain coordinate descent on covariances."""
    w = np.zeros(len(cross))
    for _ in range(20_000):
        for j in range(len(w)):
            r = cross[j] - gram[j] @ w + gram[j, j] * w[j]
            w[j] = np.sign(r) * max(abs(r) - alpha, 0) / gram[j, j] if gram[j, j] > 0 else 0.0
    return w


@pytest.mark.parametrize("seed", range(6))
def test_homotopy_equals_coordinate_descent(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 6)) @ (np.eye(6) + 0.6 * rng.normal(size=(6, 6)))
    y = x @ rng.normal(size=6) + rng.normal(size=60)
    x, y = x - x.mean(0), y - y.mean()
    gram, cross = x.T @ x / 60, x.T @ y / 60
    alphas, weights = m.lasso_homotopy(gram, cross)
    assert (np.diff(alphas) <= 0).all() and alphas[-1] == 0
    assert np.allclose(weights[-1], np.linalg.solve(gram, cross))
    path = m.LassoPath(tuple("abcdef"), alphas, weights, np.zeros(7))
    for alpha in np.linspace(0.02, 1.1, 7) * alphas[0]:
        assert np.allclose(path.at(alpha).weights, descent(gram, cross, alpha), atol=1e-7)


def test_homotopy_of_odd_features():
    gram = np.array([[1.0, 1.0, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 0.0]])  # a copy and a constant
    alphas, weights = m.lasso_homotopy(gram, np.array([2.0, 2.0, 0.0]))
    assert alphas[0] == 2 and np.allclose(weights[-1], [2, 0, 0])
    alphas, weights = m.lasso_homotopy(np.eye(2), np.zeros(2))
    assert (weights == 0).all()


def test_path_equals_the_optimizer(planted):
    x, y, df = planted
    scaled = m.standardize(df, df, NAMES)
    paths = m.lasso_paths(scaled.withColumn("z", -F.col("y") + F.col("a")), NAMES, ["y", "z"])
    for alpha in (0.05, 0.7, 1.0, 3.0):
        for target in ("y", "z"):
            want = m.lasso_fit(scaled.withColumn("z", -F.col("y") + F.col("a")), NAMES, target, alpha)
            got = paths[target].at(alpha)
            assert np.allclose(got.weights, want.coefficients.toArray(), atol=1e-6) and abs(got.intercept - want.intercept) < 1e-6


def test_lasso_equals_coordinate_descent(planted):
    x, y, df = planted
    z = (x - x.mean(0)) / x.std(0)
    w = np.zeros(4)
    for _ in range(2000):
        for j in range(4):
            rest = y - y.mean() - z @ w + z[:, j] * w[j]
            c = z[:, j] @ rest / len(y)
            w[j] = np.sign(c) * max(abs(c) - 1.0, 0)
    scaled = m.standardize(df, df, NAMES)
    model = m.lasso_fit(scaled, NAMES, "y")
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-5)
    assert m.lasso_select(scaled, NAMES, ["y"])["y"] == [n for n, v in zip(NAMES, w) if abs(v) > 0]
    assert m.lasso_select(scaled, NAMES, ["y"], alpha=1e6)["y"] == []


def test_stack_beats_the_mean_and_handles_no_features(planted):
    _, y, df = planted
    scaled = m.fold_assign(m.standardize(df, df, NAMES), "id", 5)
    stack = m.stack_regressors(scaled, NAMES, "y", "fold", numTrees=20)
    row = m.regression_metrics(stack.transform(scaled), [], "y", "stacked").first()
    assert row["r2"] > 0.95
    mean = m.stack_regressors(scaled, [], "y", "fold").transform(scaled).first()
    assert mean["stacked"] == pytest.approx(y.mean())
    single = m.stack_regressors(scaled, ["a"], "y", "fold", numTrees=5)
    assert len(single.pls.weights) == 1


def test_latent_index_against_svd(planted):
    x, _, df = planted
    z = (x - x.mean(0)) / x.std(0)
    v = np.linalg.svd(z, full_matrices=False)[2][0]
    v = -v if v.sum() < 0 else v
    s = z @ v
    want = (s - s.min()) / (s.max() - s.min()) * 100
    got = [r["latent_index"] for r in m.latent_index(df, NAMES).orderBy("id").collect()]
    assert np.allclose(got, want, atol=1e-6)
    model = m.shifted_component(df, NAMES, 5.0)
    low = df.agg(F.min(model.score())).first()[0]
    assert low == pytest.approx(5.0) and 0 < model.extra["explained"] <= 1


def test_latent_index_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (None, 1.0), (5.0, 9.0)], "a double, b double")
    got = m.latent_index(df, ["a", "b"])
    assert got.count() == 3
    low, high = got.agg(F.min("latent_index"), F.max("latent_index")).first()
    assert low == pytest.approx(0.0, abs=1e-9) and high == pytest.approx(100.0)


def test_metrics_and_spearman_with_ties(spark):
    rows = [(1.0, 1.5), (2.0, 1.5), (3.0, 3.0), (4.0, 2.0), (4.0, 5.0)]
    df = spark.createDataFrame([("t", *r) for r in rows], "g string, y double, p double")
    row = m.regression_metrics(df, ["g"], "y", "p").first()
    y, p = np.array(rows).T
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row["mae"] == pytest.approx(abs(y - p).mean()) and row["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    import pandas as pd

    want = pd.Series(y).rank().corr(pd.Series(p).rank())
    assert m.spearman(df, ["g"], "y", "p").first()["spearman"] == pytest.approx(want)


def test_stored_weights_score(planted, spark):
    _, _, df = planted
    model = m.ols_fit(df, NAMES, "y")
    tables = m.model_tables(spark, {"y": model})
    a = df.select("id", model.score().alias("p")).orderBy("id").collect()
    b = m.linear_score(df, ["id"], tables).orderBy("id").collect()
    assert np.allclose([r["p"] for r in a], [r["prediction"] for r in b])
    assert m.weights_pivot(tables, ["y"]).count() == 4


def test_grid_search_marks_one_point(planted, spark):
    _, _, df = planted
    folded = m.fold_assign(df, "id", 3)
    found = m.grid_search(folded, NAMES, "y", "fold", {"numTrees": (5,), "maxDepth": (2, 4), "minInstancesPerNode": (1,)})
    rows = m.grid_table(spark, found).collect()
    assert len(rows) == 2 and sum(r["best"] for r in rows) == 1


def test_nowcast_out_of_sample(spark):
    rng = np.random.default_rng(3)
    rows = []
    for year in (2020, 2022):
        for a in range(32):
            f = rng.normal(size=3) * 4
            rows.append((f"area{a}", year, year * 100 + a, *map(float, f), float(3 * f[0] - 2 * f[1] + rng.normal())))
    panel = spark.createDataFrame(rows, "state string, year int, row long, f1 double, f2 double, f3 double, t double")
    predictions, metrics, chosen = nowcast(panel, "state", "year", "row", ["f1", "f2", "f3"], ["t"], [2020], [2022])
    assert predictions.count() == 32 and set(predictions.columns) >= {"actual", "rf", "pls", "stacked"}
    r2 = {r["model"]: r["r2"] for r in metrics.collect()}
    assert r2["stacked"] > 0.8
    assert chosen.first()["selected_features"].startswith("f1, f2")


def test_panel_and_nulls(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "state string, v int")
    b = spark.createDataFrame([("x", 5)], "state string, w int")
    panel = reshape.assemble_panel({2020: [a, b], 2022: [a, b]}, "state")
    assert {(r["year"], r["rows"]) for r in reshape.panel_rows(panel).collect()} == {(2020, 1), (2022, 1)}
    df = spark.createDataFrame([("g", 1.0)] * 10 + [("h", 1.0)] * 9 + [("g", None)], "k string, v double")
    assert reshape.null_handling(df, ["v"], "drop", "k", 10).count() == 10
    assert reshape.null_handling(df, ["v"], "fill").where("v = 0").count() == 1
