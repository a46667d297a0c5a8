"""Fits against NumPy answers on small fixtures."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lodestar.functions.columns import digamma, falling_sums, trigamma
from lodestar.functions.stats import incomplete_beta, normal_p, t_p
from lodestar.operators import evaluation as ev
from lodestar.operators import features as fe
from lodestar.operators import models as mo
from lodestar.operators import neighbors as nn
from lodestar.operators import panel as pa


def estimates(table):
    return {r.term: (r.estimate, r.se) for r in table.collect()}


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(5)
    rows = []
    for e in range(12):
        for y in range(6):
            if rng.random() < 0.15:
                continue
            x, z = rng.normal(), rng.normal()
            mu = np.exp(0.3 * x - 0.2 * z + 0.1 * e + 0.05 * y - 0.4)
            rows.append((e, y, x, z, int(rng.poisson(mu)), 1.5 * x - z + e + 0.3 * y + rng.normal()))
    return pd.DataFrame(rows, columns=["e", "y", "x", "z", "count", "resp"])


def design(p, entity=True, time=True):
    cols = [p.x, p.z]
    if entity:
        cols += [(p.e == v).astype(float) for v in sorted(p.e.unique())]
    if time:
        cols += [(p.y == v).astype(float) for v in sorted(p.y.unique())[1 if entity else 0:]]
    return np.column_stack(cols)


@pytest.mark.parametrize("entity,time", [(True, False), (False, True), (True, True)])
def test_within(spark, panel, entity, time):
    X = design(panel, entity, time)
    b, *_ = np.linalg.lstsq(X, panel.resp, rcond=None)
    res = panel.resp - X @ b
    dof = len(panel) - X.shape[1]
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * (res @ res) / dof)
    got = estimates(pa.within(spark.createDataFrame(panel), "resp", ["x", "z"], "e" if entity else None, "y" if time else None))
    assert got["x"] == pytest.approx((b[0], se[0]), rel=1e-6)
    assert got["z"] == pytest.approx((b[1], se[1]), rel=1e-6)


@pytest.mark.parametrize("time", [False, True])
def test_poisson_effects(spark, panel, time):
    X, y = design(panel, True, time), panel["count"].to_numpy(float)
    b = np.zeros(X.shape[1])
    for _ in range(60):
        mu = np.exp(X @ b)
        b += np.linalg.solve(X.T @ (mu[:, None] * X), X.T @ (y - mu))
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ (np.exp(X @ b)[:, None] * X))))
    got = estimates(pa.poisson_fe(spark.createDataFrame(panel), "count", ["x", "z"], "e", "y" if time else None))
    assert got["x"] == pytest.approx((b[0], se[0]), rel=1e-5)
    assert got["z"] == pytest.approx((b[1], se[1]), rel=1e-5)


def climbs(f, at, eps=1e-3):
    """No coordinate step improves a maximum."""
    best = f(at)
    return all(f(at + s * eps * np.eye(len(at))[i]) < best for i in range(len(at)) for s in (-1, 1))


def test_negative_binomial_is_a_maximum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    y = rng.negative_binomial(2, 2 / (2 + np.exp(0.5 + 0.4 * x)))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    table, theta = pa.neg_binomial(df, "y", {"x": F.col("x")})
    est = estimates(table)

    def loglik(v):
        mu, th = np.exp(v[0] + v[1] * x), v[2]
        return sum(math.lgamma(a + th) - math.lgamma(th) - math.lgamma(a + 1) + th * np.log(th / (th + m)) + a * np.log(m / (m + th))
                   for a, m in zip(y, mu))

    assert climbs(loglik, np.array([est["(intercept)"][0], est["x"][0], theta]))


def test_zero_inflated_terms_are_selected(spark):
    rng = np.random.default_rng(5)
    x, noise, z = rng.normal(size=(3, 1500))
    y = np.where(rng.random(1500) < 1 / (1 + np.exp(1 - 1.5 * z)), 0, rng.poisson(np.exp(0.6 + 0.4 * x)))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "noise": noise, "z": z, "y": y}))
    terms, zeros = {n: F.col(n) for n in ("x", "noise")}, {n: F.col(n) for n in ("z", "noise")}
    whole = {r.term: r for r in pa.zero_inflated_poisson(df, "y", terms, zeros, alpha=None).collect()}
    kept = {r.term: r for r in pa.zero_inflated_poisson(df, "y", terms, zeros).collect()}
    assert kept == {n: r for n, r in whole.items() if r.p < 0.05}
    assert {"count:x", "zero:z"} <= set(kept) and len(kept) < len(whole)
    assert whole["count:x"].estimate == pytest.approx(0.4, abs=0.1) and whole["zero:z"].estimate == pytest.approx(1.5, abs=0.4)


def test_counts_without_extra_zeros(spark):
    y = np.repeat([1, 2, 3, 4], 50)
    df = spark.createDataFrame(pd.DataFrame({"y": y}))
    whole = {r.term: r for r in pa.zero_inflated_poisson(df, "y", {}, {}, alpha=None).collect()}
    assert whole["count:(intercept)"].estimate == pytest.approx(math.log(2.5), abs=1e-5)
    zero = whole["zero:(intercept)"]
    assert zero.se == math.inf and zero.p == 1
    assert [r.term for r in pa.zero_inflated_poisson(df, "y", {}, {}).collect()] == ["count:(intercept)"]


def test_zero_inflated_poisson_is_a_maximum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=500)
    y = np.where(rng.random(500) < 0.3, 0, rng.poisson(np.exp(0.6 + 0.3 * x)))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    est = estimates(pa.zero_inflated_poisson(df, "y", {"x": F.col("x")}, {}, alpha=None))

    def loglik(v):
        lam, p = np.exp(v[0] + v[1] * x), 1 / (1 + np.exp(-v[2]))
        logf = [math.lgamma(a + 1) for a in y]
        return np.where(y == 0, np.log(p + (1 - p) * np.exp(-lam)), np.log(1 - p) + y * np.log(lam) - lam - logf).sum()

    assert climbs(loglik, np.array([est["count:(intercept)"][0], est["count:x"][0], est["zero:(intercept)"][0]]))


@pytest.mark.parametrize("ties", ["breslow", "efron"])
def test_cox_is_a_maximum(spark, ties):
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    t = np.ceil(rng.exponential(np.exp(-0.7 * x)) * 4)
    e = (rng.random(60) < 0.8).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "e": e, "x": x}))
    est = estimates(pa.cox(df, "t", "e", ["x"], ties))

    def loglik(v):
        r, out = np.exp(v[0] * x), 0.0
        for when in np.unique(t[e == 1]):
            dead = (t == when) & (e == 1)
            d = dead.sum()
            out += v[0] * x[dead].sum()
            for k in range(d):
                out -= np.log(r[t >= when].sum() - (k / d * r[dead].sum() if ties == "efron" else 0))
        return out

    assert climbs(loglik, np.array([est["x"][0]]))


def test_fractional_logit(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=200)
    y = np.clip(1 / (1 + np.exp(-(0.2 + 0.5 * x))) + rng.normal(0, 0.1, 200), 0, 1)
    X, b = np.column_stack([np.ones(200), x]), np.zeros(2)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-X @ b))
        b += np.linalg.solve(X.T @ ((mu * (1 - mu))[:, None] * X), X.T @ (y - mu))
    mu = 1 / (1 + np.exp(-X @ b))
    disp = ((y - mu) ** 2 / (mu * (1 - mu))).sum() / 198
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ ((mu * (1 - mu))[:, None] * X))) * disp)
    table, got = pa.fractional_logit(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "y", {"x": F.col("x")})
    assert got == pytest.approx(disp)
    assert estimates(table)["x"] == pytest.approx((b[1], se[1]))


def test_many_terms_take_the_spread_path(spark):
    rng = np.random.default_rng(8)
    X = rng.normal(size=(50, 12))
    df = spark.createDataFrame(pd.DataFrame(X, columns=[f"c{i}" for i in range(12)]))
    a, b = pa.cross_products(df, [F.col(f"c{i}") for i in range(11)], F.lit(2.0), [F.col("c11")])
    assert np.allclose(a, 2 * X[:, :11].T @ X[:, :11]) and np.allclose(b[:, 0], 2 * X[:, :11].T @ X[:, 11])


def test_orthogonal_polynomial(spark):
    x = np.array([1.0, 2, 2, 5, 9, 14])
    out = pa.ortho_poly(spark.createDataFrame(pd.DataFrame({"x": x})), "x").toPandas()
    m = np.column_stack([np.ones(6), out.x_p1, out.x_p2])
    assert np.allclose(m[:, 1:].T @ m[:, 1:], np.eye(2)) and np.allclose(m.sum(0)[1:], 0)


def test_tail_probabilities():
    assert t_p(2.0, 10) == pytest.approx(0.07338803477, rel=1e-8)
    assert t_p(-3.5, 4) == pytest.approx(0.0248961634602)
    assert normal_p(1.959963985) == pytest.approx(0.05, rel=1e-8)
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)


def test_digamma(spark):
    row = spark.range(1).select(digamma(F.lit(1.0)), digamma(F.lit(0.3)), trigamma(F.lit(1.0)), digamma(F.lit(50.0))).first()
    assert row[0] == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert row[1] == pytest.approx(-3.5025242222001332, abs=1e-11)
    assert row[2] == pytest.approx(math.pi ** 2 / 6, abs=1e-11)
    assert row[3] == pytest.approx(3.9019896734278921, abs=1e-12)


@pytest.mark.parametrize("a,d", [(1.0, 1), (5.0, 5), (7.3, 2), (40.5, 39), (1e6 + 0.5, 3), (3e5, 250_000), (1e12, 1000)])
def test_falling_sums(spark, a, d):
    """Sums over tied events equal their spread form, also where log gamma itself would lose all digits."""
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(float(d)).alias("d")).select(*falling_sums("a", "d")).first()
    rest = a - np.arange(d)
    for got, want in zip(row, (math.fsum(np.log(rest)), math.fsum(1 / rest), math.fsum(1 / rest ** 2))):
        assert got == pytest.approx(want, rel=1e-11)


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(120, 3))
    y = X @ [2.0, -1.0, 0.0] + 3 + rng.normal(0, 0.5, 120)
    df = spark.createDataFrame(pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "c": X[:, 2], "y": y, "d": (y > 3).astype(int)}))
    return X, y, df


def test_ridge(regression):
    X, y, df = regression
    Xc, yc = X - X.mean(0), y - y.mean()
    want = np.linalg.solve(Xc.T @ Xc + 10 * np.eye(3), Xc.T @ yc)
    model = mo.ridge(10.0, 120, float(y.std())).fit(mo.assemble(df, ["a", "b", "c"], "y"))
    assert model.coefficients.toArray() == pytest.approx(want, rel=1e-6)


def test_lasso_is_a_minimum(regression):
    X, y, df = regression
    model = mo.lasso(0.3).fit(mo.assemble(df, ["a", "b", "c"], "y"))
    at = np.r_[model.intercept, model.coefficients.toArray()]
    cost = lambda v: -((y - v[0] - X @ v[1:]) ** 2).sum() / 240 - 0.3 * np.abs(v[1:]).sum()
    assert climbs(cost, at) and abs(at[3]) < 1e-9


def test_logistic_penalty(regression):
    X, y, df = regression
    d, c = (y > 3).astype(float), 0.7
    Z, b = np.column_stack([np.ones(120), X]), np.zeros(4)
    pen = np.diag([0, 1, 1, 1]) / c
    for _ in range(100):
        mu = 1 / (1 + np.exp(-Z @ b))
        b += np.linalg.solve(Z.T @ ((mu * (1 - mu))[:, None] * Z) + pen, Z.T @ (d - mu) - pen @ b)
    model = mo.logistic(120, c).fit(mo.assemble(df, ["a", "b", "c"], "d"))
    assert np.r_[model.intercept, model.coefficients.toArray()] == pytest.approx(b, abs=1e-4)


def test_stepwise_drops_noise(regression):
    _, _, df = regression
    noisy = df.withColumn("d", F.when(F.xxhash64("y") % 5 == 0, 1 - F.col("d")).otherwise(F.col("d")))
    terms, path = mo.stepwise_logistic(noisy, ["a", "b", "c"], "d")
    assert "a" in terms
    assert all(x[1] > y[1] for x, y in zip(path, path[1:]))


def test_tree_and_importances(regression):
    _, _, df = regression
    model = mo.tree(depth=3).fit(mo.assemble(df, ["a", "b", "c"], "d"))
    size = mo.tree_summary(model)
    assert size["depth"] <= 3 and size["leaves"] <= 8
    assert mo.importances(model, ["a", "b", "c"], df).first().feature == "a"


def test_top_components_of_wide_rows(spark, monkeypatch):
    """More columns than a whole matrix may have; values, axes, shares and rebuild against a singular value decomposition."""
    rng = np.random.default_rng(8)
    width, d = 6000, 4
    x = rng.normal(size=(40, 6)) * [9, 7, 5, 4, 0.3, 0.2] @ rng.normal(size=(6, width)) / 50 + rng.normal(size=width)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, v array<double>").repartition(3)
    got = mo.top_components(df, "v", d)
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(got.values, s[:d] ** 2 / 39, rtol=1e-8)
    assert np.allclose(np.abs(np.sum(got.axes * vt[:d].T, axis=0)), 1, atol=1e-6)
    assert np.allclose(got.share(), np.cumsum(s[:d] ** 2) / (s ** 2).sum())
    scores = {r.i: r.scores for r in got.project(df, "v", d).select("i", "scores").collect()}
    for i in range(40):
        assert np.allclose(np.abs(scores[i]), np.abs(centred[i] @ vt[:d].T), atol=1e-5)
    with pytest.raises(ValueError, match="one width"):
        mo.top_components(df.limit(0), "v", 2)


def test_components(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 6))
    Xc = X - X.mean(0)
    values = np.linalg.eigvalsh(Xc.T @ Xc / 39)[::-1]
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(X)], "id int, v array<double>")
    comp = mo.pca(df, "v")
    assert comp.values == pytest.approx(values)
    assert np.allclose(comp.axes.T @ comp.axes, np.eye(6))
    back = comp.rebuild(comp.project(df, "v", 6), "scores").orderBy("id").collect()
    assert np.allclose([r.rebuilt for r in back], X)
    long = df.select("id", F.posexplode("v").alias("j", "x"))
    wide, axes, scores = mo.pca_wide(long, "id", "j", "x", 2)
    assert wide[:6] == pytest.approx(values)
    A = np.array([r.axis for r in axes.orderBy("j").collect()])
    S = np.array([r.scores for r in scores.orderBy("id").collect()])
    assert np.allclose(A.T @ A, np.eye(2)) and np.allclose(Xc @ A, S)


@pytest.fixture(scope="module")
def cloud(spark):
    """A third of the rows are copies of one point."""
    rng = np.random.default_rng(11)
    X = np.round(rng.normal(size=(300, 3)), 3)
    X[:100] = X[0]
    y = rng.integers(0, 4, 300)
    df = spark.createDataFrame([(i, list(map(float, x)), int(c)) for i, (x, c) in enumerate(zip(X, y))],
                               "id long, v array<double>, y int")
    return X, y, df


@pytest.mark.parametrize("p", [1, 2])
def test_neighbours_are_exact(spark, cloud, monkeypatch, p):
    X, _, df = cloud
    monkeypatch.setattr(nn, "BLOCK_ROWS", 16)
    q = df.select(F.col("id").alias("q"), "v")
    got = {}
    for r in nn.knn_candidates(df, q, "id", "q", "v", 6, p, exclude_same=True).collect():
        got.setdefault(r.q, []).append((r["rank"], r.id, r.dist))
    diff = X[:, None] - X[None]
    d = np.sqrt((diff ** 2).sum(-1)) if p == 2 else np.abs(diff).sum(-1)
    for i in range(300):
        near = sorted(got[i])
        assert [g[2] for g in near] == pytest.approx(np.sort(np.delete(d[i], i))[:6])
        assert [g[2] for g in near] == pytest.approx([d[i, g[1]] for g in near]) and len({g[1] for g in near}) == 6


def test_imputation(spark):
    rng = np.random.default_rng(12)
    X = rng.normal(size=(80, 3))
    M = X.copy()
    M[rng.random(M.shape) < 0.2] = np.nan
    M[np.isnan(M).all(1)] = 0.5
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(M)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r.id: r for r in nn.knn_impute(df, "id", ["a", "b", "c"], 4).collect()}
    for i, k in itertools.product(range(80), range(3)):
        want = M[i, k]
        if np.isnan(want):
            cand = []
            for j in range(80):
                both = ~np.isnan(M[i]) & ~np.isnan(M[j])
                if not np.isnan(M[j, k]) and both.any():
                    cand.append((np.sqrt(3 / both.sum() * ((M[i] - M[j])[both] ** 2).sum()), j))
            best = sorted(cand)[:4]
            want = sum(M[j, k] / d for d, j in best) / sum(1 / d for d, _ in best)
        assert got[i]["abc"[k]] == pytest.approx(want)


def test_imputation_prefers_exact_matches(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, 1.0, 5.0), (2, 1.0, 7.0), (3, 9.0, 100.0)], "id long, a double, b double")
    got = {r.id: r.b for r in nn.knn_impute(df, "id", ["a", "b"], 3).collect()}
    assert got == {0: 6.0, 1: 5.0, 2: 7.0, 3: 100.0}


def test_metrics_and_search(spark, regression):
    _, _, df = regression
    rows = fe.assign_fold(mo.assemble(df.withColumn("id", F.monotonically_increasing_id()), ["a", "b", "c"], "d"), "id", 3).cache()
    out = {r.metric: r.mean for r in ev.cv_scores(mo.tree(depth=3), rows, "fold").collect()}
    assert 0.7 < out["accuracy"] <= 1
    table, best, top = ev.grid_search(mo.tree(), rows, {"maxDepth": [1, 3]}, "fold", "accuracy")
    assert table.count() == 2 and best["maxDepth"] in (1, 3)
    assert top == pytest.approx(max(r["mean"] for r in table.collect()))


def test_category_model_beats_the_base_rate(spark):
    rng = np.random.default_rng(13)
    k = rng.integers(0, 5, 1000)
    y = (rng.random(1000) < np.array([0.1, 0.9, 0.5, 0.2, 0.8])[k]).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": range(1000), "k": k, "g": k % 2, "y": y}))
    model = mo.fit_category_fm(df, ["k", "g"], "y", max_iter=200, step=0.1)
    base = -(y.mean() * np.log(y.mean()) + (1 - y.mean()) * np.log(1 - y.mean()))
    assert ev.log_loss(model.transform(df), "y", "p1").first()[0] < base - 0.1


def test_nets(spark, regression):
    _, _, df = regression
    rows = mo.assemble(df, ["a", "b", "c"], "d")
    model, rounds = mo.fit_mlp(rows, rows, 3, [4], (1, 50))
    assert rounds == 50
    scored = model.transform(rows)
    assert ev.class_metrics(scored, "label", "prediction", 1.0).first().accuracy > 0.85
    assert scored.select(vector_to_array("probability")[1]).count() == 120


def _neighbour_answer(rows, train, k, weights, metric):
    """Plain answers by brute force: (predicted, truth) per row."""
    out = []
    for _, v, y in rows:
        near = sorted((float(np.linalg.norm(np.subtract(v, u))), i, z) for i, u, z in train)[:k]
        zero = near[0][0] == 0
        w = [1.0 if weights == "uniform" else float(d == 0) if zero else 1 / d for d, _, _ in near]
        if metric == "rmse":
            out.append((sum(a * z for a, (_, _, z) in zip(w, near)) / sum(w), y))
        else:
            votes = {z: round(sum(a for a, (_, _, q) in zip(w, near) if q == z), 9) for _, _, z in near}
            out.append((min(votes, key=lambda z: (-votes[z], z)), y))
    return out


def _score(pairs, metric):
    return (np.sqrt(np.mean([(a - y) ** 2 for a, y in pairs])) if metric == "rmse" else np.mean([a == y for a, y in pairs]))


@pytest.mark.parametrize("metric", ["accuracy", "rmse"])
def test_neighbour_search_against_brute_force(spark, metric):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.integers(0, 6, 2)], int(rng.integers(0, 3)), i % 3, i % 4) for i in range(90)]
    extra = [(900, [0.0, 0.0], None, 0, 0), (901, [0.0, 0.0], 1, None, None)]
    df = spark.createDataFrame(data + extra, "id long, v array<double>, y int, outer int, inner int")
    grid = [(w, k) for k in (1, 4, 9) for w in ("distance", "uniform")]

    def scores(rows, at):
        pick = lambda keep: [(r[0], r[1], r[2]) for r in rows if keep(r[at])]
        return {(w, k, f): _score(_neighbour_answer(pick(lambda x: x == f), pick(lambda x: x != f), k, w, metric), metric)
                for w, k in grid for f in sorted({r[at] for r in rows})}

    want = scores(data, 4)
    got = nn.knn_fold_scores(df, "id", "v", "y", "inner", [1, 4, 9], metric=metric).collect()
    assert {(r.weights, r.k, r.fold): round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    table = nn.knn_search(df, "id", "v", "y", "inner", [1, 4, 9], metric=metric).orderBy("rank").collect()
    assert [r.rank for r in table] == list(range(1, 7))
    means = [r["mean"] for r in table]
    assert means == pytest.approx(sorted(means, reverse=metric == "accuracy"))

    sign, outside = (1 if metric == "accuracy" else -1), scores(data, 3)
    for r in nn.knn_nested(df, "id", "v", "y", "outer", "inner", [1, 4, 9], metric=metric).collect():
        inside = scores([x for x in data if x[3] != r.fold], 4)
        mean = {g: float(np.mean([inside[(*g, f)] for f in range(4)])) for g in grid}
        best = min(grid, key=lambda g: (-sign * round(mean[g], 12), g[1], g[0]))
        assert (r.weights, r.k) == best
        assert (r.inner, r.outer) == pytest.approx((mean[best], outside[(*best, r.fold)]))


def test_errors_of_held_out_folds(spark):
    data = [(float(i), 2.0 * i + (i % 3), i % 4) for i in range(40)]
    rows = mo.assemble(spark.createDataFrame(data, "x double, y double, fold int"), ["x"], "y")
    got = {r.metric: (r.mean, r.sd) for r in ev.cv_scores(mo.linear(), rows, "fold", ev.ERROR_METRICS).collect()}
    each = {"rmse": [], "mae": [], "r2": []}
    for f in range(4):
        x, y = np.array([d[:2] for d in data if d[2] != f]).T
        b, a = np.polyfit(x, y, 1)
        tx, ty = np.array([d[:2] for d in data if d[2] == f]).T
        off = ty - a - b * tx
        each["rmse"].append(np.sqrt((off ** 2).mean()))
        each["mae"].append(np.abs(off).mean())
        each["r2"].append(1 - (off ** 2).mean() / ty.var())
    for m, v in each.items():
        assert got[m] == pytest.approx((np.mean(v), np.std(v)), abs=1e-8)
    with pytest.raises(ValueError):
        ev.cv_scores(mo.linear(), rows, "fold", ["rmse", "accuracy"])
