import numpy as np
import pytest

from numeriq.operators import precondition, solvers


def frame(spark, a):
    n = len(a)
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]], "i long, j long, v double")


def lattice(k):
    """The five-point operator of a k x k grid with some drift, so that it isn't symmetric."""
    a = np.zeros((k * k, k * k))
    for r in range(k):
        for c in range(k):
            i = r * k + c
            a[i, i] = 4.2 + 0.1 * (i % 3)
            for p, q, v in ((1, 0, -1.3), (-1, 0, -0.7), (0, 1, -1.1), (0, -1, -0.9)):
                if 0 <= r + p < k and 0 <= c + q < k:
                    a[i, (r + p) * k + c + q] = v
    return a


def test_factor_has_the_pattern_and_the_product(spark):
    a = lattice(5)
    t, colours, n = precondition.incomplete_lu(frame(spark, a))
    colour = {r["i"]: r["colour"] for r in colours.collect()}
    assert all(colour[i] != colour[j] for i in range(25) for j in range(25) if i != j and (a[i, j] or a[j, i])) and n <= 5
    order = sorted(range(25), key=lambda i: (colour[i], i))
    place = {i: k for k, i in enumerate(order)}
    lower, upper = np.eye(25), np.zeros((25, 25))
    for r in t.collect():
        i, j = place[r["i"]], place[r["j"]]
        (lower if i > j else upper)[i, j] = r["v"]
    product, want = lower @ upper, a[np.ix_(order, order)]
    # No fill: the product is the matrix where the matrix has entries.
    assert np.allclose(product[want != 0], want[want != 0], atol=1e-12)
    solve = precondition.lu_solver(frame(spark, a))
    x = np.arange(25.0) - 7
    got = {r["i"]: r["x"] for r in solve(spark.createDataFrame([(i, float(x[i])) for i in range(25)], "i long, x double")).collect()}
    z = np.linalg.solve(lower @ upper, x[order])
    assert np.allclose([got[i] for i in order], z)


def test_it_saves_iterations(spark):
    a = lattice(6)
    df = frame(spark, a)
    b = spark.createDataFrame([(i, float(i % 5 - 1)) for i in range(36)], "i long, x double")
    plain, h0 = solvers.gmres(df, b, 30, 2, 1e-8)
    better, h1 = solvers.gmres(df, b, 30, 2, 1e-8, precondition.lu_solver(df))
    want = np.linalg.solve(a, [i % 5 - 1 for i in range(36)])
    for x in (plain, better):
        assert np.allclose([r["x"] for r in x.orderBy("i").collect()], want, atol=1e-6)
    assert len(h1) < len(h0)


def test_missing_pivots_are_told(spark):
    with pytest.raises(ValueError):
        precondition.incomplete_lu(spark.createDataFrame([(0, 1, 1.0), (1, 0, 2.0), (1, 1, 1.0)], "i long, j long, v double"))


def test_condition_of_a_made_matrix(spark):
    a = precondition.prescribed_condition(spark, 12, 500.0)
    x = np.zeros((12, 12))
    for r in a.collect():
        x[r["i"], r["j"]] = r["v"]
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(s, 500.0 ** (-np.arange(12) / 11), atol=1e-12)
    inverse = np.linalg.inv(x)

    def by(m):
        def solve(b):
            v = np.zeros(12)
            for r in b.collect():
                v[r["i"]] = r["x"]
            return spark.createDataFrame([(i, float(y)) for i, y in enumerate(m @ v)], "i long, x double")

        return solve

    true = np.abs(x).sum(0).max() * np.abs(inverse).sum(0).max()
    got = precondition.condition_estimate(a, by(inverse), by(inverse.T))
    assert true / 3 <= got <= true * (1 + 1e-9)
    assert precondition.growth_factor(frame(spark, lattice(4))) <= 1.0 + 1e-12


def test_a_known_colouring_is_taken(spark):
    a = lattice(6)
    df = frame(spark, a)
    two = df.select("i").distinct().selectExpr("i", "(i div 6 + i % 6) % 2 AS colour")
    t, colours, n = precondition.incomplete_lu(df, two)
    assert n == 2 and {r["i"]: r["colour"] for r in colours.collect()} == {r["i"]: r["colour"] for r in two.collect()}
    order = sorted(range(36), key=lambda i: ((i // 6 + i % 6) % 2, i))
    place = {i: k for k, i in enumerate(order)}
    lower, upper = np.eye(36), np.zeros((36, 36))
    for r in t.collect():
        i, j = place[r["i"]], place[r["j"]]
        (lower if i > j else upper)[i, j] = r["v"]
    product, want = lower @ upper, a[np.ix_(order, order)]
    assert np.allclose(product[want != 0], want[want != 0], atol=1e-12)
    x = np.arange(36.0) - 7
    got = {r["i"]: r["x"] for r in precondition.lu_solver(df, two)(spark.createDataFrame([(i, float(x[i])) for i in range(36)], "i long, x double")).collect()}
    assert np.allclose([got[i] for i in order], np.linalg.solve(product, x[order]))
    for wrong in (two.withColumn("colour", two["colour"] * 0), two.filter("i <> 3")):
        with pytest.raises(ValueError):
            precondition.incomplete_lu(df, wrong)
