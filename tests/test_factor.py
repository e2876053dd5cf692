import numpy as np
import pytest

from numeriq.operators import estimators, factor


def points(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)


@pytest.mark.parametrize("n,p,numbers", [(500, 6, 60), (5, 7, 14), (3, 3, 1000), (700, 2, 2)])
def test_q_of_a_tree_is_that_of_the_matrix(spark, monkeypatch, n, p, numbers):
    monkeypatch.setattr(factor, "BLOCK_NUMBERS", numbers)
    x = np.random.default_rng(n).normal(size=(n, p)) * np.logspace(0, 3, p)
    df = points(spark, x)
    q, r = factor.tall_skinny_qr(df)
    got = np.array([v["q"] for v in q.orderBy("id").collect()])
    want_q, want_r = np.linalg.qr(x)
    s = np.where(np.diag(want_r) < 0, -1, 1)
    assert np.allclose(r, want_r * s[:, None], atol=1e-9) and np.allclose(got, want_q * s, atol=1e-9)
    if n > p:
        assert factor.orthogonality_error(q)["largest"] < 1e-12
    assert factor.factor_residual(df, q, r)["relative"] < 1e-13


def test_q_is_orthonormal_where_columns_depend(spark):
    x = np.random.default_rng(1).normal(size=(60, 3))
    q, r = factor.tall_skinny_qr(points(spark, np.hstack([x, x[:, :1] + x[:, 1:2]])))
    assert factor.orthogonality_error(q)["frobenius"] < 1e-12 and abs(r[3, 3]) < 1e-12
    assert factor.tall_skinny_qr(points(spark, x).limit(0))[0].count() == 0


def test_singular_vectors(spark):
    rng = np.random.default_rng(4)
    x = (rng.random((60, 40)) < 0.3) * rng.normal(size=(60, 40)) + np.outer(rng.normal(size=60), rng.normal(size=40))
    a = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(40) if x[i, j]], "i long, j long, v double")
    u, values, v = factor.randomized_svd(a, 4, power=6)
    wu, ws, wv = np.linalg.svd(x)
    flip = [1 if r[np.abs(r).argmax()] > 0 else -1 for r in wv[:4]]
    assert np.allclose(values, ws[:4], rtol=1e-4) and abs(values[0] - ws[0]) < 1e-7 * ws[0]
    got_u, got_v = np.array([r["u"] for r in u.orderBy("i").collect()]), np.array([r["v"] for r in v.orderBy("j").collect()])
    # The first is far from the rest; the others lie close together, where a sketch only finds their space.
    assert np.allclose(got_v[:, 0], wv[0] * flip[0], atol=1e-5) and np.allclose(got_u[:, 0], wu[:, 0] * flip[0], atol=1e-5)
    assert factor.orthogonality_error(u, "u")["largest"] < 1e-8 and factor.orthogonality_error(v, "v")["largest"] < 1e-8
    best = np.sqrt((ws[4:] ** 2).sum())
    error = factor.reconstruction_error(a, u, values, v)
    assert abs(error["frobenius"] - best) < 1e-4 * best and abs(error["relative"] - best / np.linalg.norm(x)) < 1e-4


def test_projection_error_is_what_the_other_components_hold(spark):
    x = np.random.default_rng(5).normal(size=(200, 5)) * [9, 5, 2, 1, 0.5]
    df = points(spark, x)
    mean, parts, _ = estimators.principal_components(df, "v", 2)
    got = factor.projection_error(df, "v", mean, parts).first()
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))
    assert abs(got["mean_squared"] - values[:3].sum()) < 1e-9
    c = x - x.mean(0)
    lost = c - c @ np.array(parts).T @ np.array(parts)
    assert abs(got["largest"] - np.sqrt((lost**2).sum(1).max())) < 1e-9
