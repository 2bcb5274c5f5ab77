import math

import numpy as np
import pytest

from colonnade.functions import special
from colonnade.operators import moments, regress


def _data(n=400, p=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * np.arange(1, p + 1) + 100
    x[:, 1] += 0.8 * x[:, 0]
    y = 3.0 + 2.0 * x[:, 0] - x[:, 2] + rng.normal(size=n) * 4
    return x, y


def _frame(spark, x, y):
    names = [f"a{i}" for i in range(x.shape[1])]
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "y"])), names


def test_tail_probabilities_match_published_tables():
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert special.t_quantile(0.975, 1) == pytest.approx(12.7062047, abs=1e-6)
    assert special.t_two_sided(2.0, 1e9) == pytest.approx(0.0455002639, abs=1e-8)
    assert special.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.beta_inc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)


@pytest.mark.parametrize("wide", [False, True])
def test_moments_both_ways(spark, wide, monkeypatch):
    x, y = _data()
    df, names = _frame(spark, x, y)
    monkeypatch.setattr(moments, "SQL_WIDTH", 0 if wide else 14)
    m = moments.cross_moments(df.repartition(3), names)
    c = x - x.mean(0)
    np.testing.assert_allclose(m.cross, c.T @ c, rtol=1e-9)
    np.testing.assert_allclose(m.mean, x.mean(0), rtol=1e-12)


def test_ols_matches_numpy(spark):
    x, y = _data()
    df, names = _frame(spark, x, y)
    fit = regress.fit_linear(moments.cross_moments(df), "y", names)
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    resid = y - design @ beta
    s2 = resid @ resid / (len(y) - 5)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * s2)
    np.testing.assert_allclose(fit.coef, beta, rtol=1e-7)
    np.testing.assert_allclose(fit.se, se, rtol=1e-7)
    llf = -len(y) / 2 * (math.log(2 * math.pi * (resid @ resid) / len(y)) + 1)
    assert fit.aic == pytest.approx(-2 * llf + 10, rel=1e-10)
    assert fit.bic == pytest.approx(-2 * llf + 5 * math.log(len(y)), rel=1e-10)


def test_p_values_match_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    x, y = _data()
    df, names = _frame(spark, x, y)
    fit = regress.fit_linear(moments.cross_moments(df), "y", names)
    rows = VectorAssembler(inputCols=names, outputCol="f").transform(df)
    want = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(rows).summary.pValues
    np.testing.assert_allclose(np.array(fit.p)[[1, 2, 3, 4, 0]], want, rtol=1e-6, atol=1e-12)


def test_backward_drops_noise_and_handles_constants(spark):
    x, y = _data()
    x[:, 3] = 5.0
    df, names = _frame(spark, x, y)
    fit, steps = regress.backward(moments.cross_moments(df), "y", names)
    assert fit.terms == ["const", "a0", "a2"] and [s[1] for s in steps] == ["a1"]
    first = regress.fit_linear(moments.cross_moments(df), "y", names)
    assert first.constant == ["a3"]


def test_backward_can_remove_everything(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 1)), np.tile([1.0, -1.0], 25)
    x[:, 0] = np.repeat([0.0, 1.0], 25)
    df, names = _frame(spark, x, y)
    fit, steps = regress.backward(moments.cross_moments(df), "y", names)
    assert fit.terms == ["const"] and len(steps) == 1


def test_pca_svd_vif_match_numpy(spark):
    x, y = _data()
    df, names = _frame(spark, x, y)
    z = (x - x.mean(0)) / x.std(0)
    ratio = np.linalg.svd(z, compute_uv=False) ** 2
    np.testing.assert_allclose(moments.pca(df, names).ratio, ratio / ratio.sum(), rtol=1e-9)
    kept = z.copy()
    kept[:, 3] = x[:, 3]
    s = np.linalg.svd(kept, compute_uv=False)[:3] ** 2
    found = moments.svd(df, names, ignore=["a3"])
    np.testing.assert_allclose(found.share, s / s.sum(), rtol=1e-9)
    u, sv, vt = np.linalg.svd(kept, full_matrices=False)
    scores = kept @ vt[:3].T
    np.testing.assert_allclose(found.ratio, scores.var(0) / kept.var(0).sum(), rtol=1e-7)
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    np.testing.assert_allclose([r.vif for r in moments.vif(df, names).collect()], want, rtol=1e-8)
    projected = moments.pca(df, names).project(df, 2).select("pc1", "pc2").toPandas()
    np.testing.assert_allclose(projected.var(ddof=0).sum(), ratio[:2].sum() / len(x), rtol=1e-8)


def test_vif_of_collinear_and_constant(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0, float(i * i % 7)) for i in range(20)], "a double, b double, c double, d double")
    got = {r.feature: r.decision for r in moments.vif(df).collect()}
    assert got == {"a": "remove", "b": "remove", "c": "undecided", "d": "keep"}


def test_too_few_bins_is_an_error(spark):
    df = spark.sql("select timestamp_ntz '2024-01-01 00:00:00' as ts, 1.0D as x, 2.0D as y")
    with pytest.raises(ValueError):
        regress.stepwise_by_time(df, "y", "ts")
