"""GMRES on vectors in blocks, and an incomplete LU as a product of sparse matrices."""

import numpy as np

from numeriq.operators import blocks, precondition, solvers
from numeriq.plans.registry import QUERIES
from test_precondition import frame, lattice


def test_factors_are_the_inverse_of_the_incomplete_lu(spark):
    a = lattice(4)
    df = frame(spark, a)
    colours = precondition.coloured(df)
    t, _, n = precondition.incomplete_lu(df, colours)
    lower, upper = np.eye(16), np.zeros((16, 16))
    for r in t.collect():
        (lower if r["ci"] > r["cj"] else upper)[r["i"], r["j"]] = r["v"]
    factors = precondition.lu_factors(df, colours)
    inverse = np.eye(16)
    for f in factors:
        m = np.zeros((16, 16))
        for r in f.collect():
            m[r["i"], r["j"]] += r["v"]
        inverse = m @ inverse
    assert n > 2 and len(factors) == 2 * (n - 1) and np.allclose(inverse @ lower @ upper, np.eye(16), atol=1e-12)


def test_products_and_sums_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "WIDTH", 4)
    rng = np.random.default_rng(3)
    a = np.where(rng.random((15, 15)) < 0.3, rng.normal(size=(15, 15)), 0)
    x = rng.normal(size=15)
    df = spark.createDataFrame([(i - 6, j - 6, float(a[i, j])) for i in range(15) for j in range(15) if a[i, j]], "i long, j long, v double")
    v = blocks.blocked(spark.createDataFrame([(i - 6, float(x[i])) for i in range(15)], "i long, x double"))
    got = {r["i"] + 6: r["x"] for r in blocks.unblocked(blocks.product(blocks.matrix(df), v)).collect()}
    assert got.keys() == set(np.flatnonzero((a != 0).any(1))) and all(abs(got[i] - (a @ x)[i]) < 1e-12 for i in got)
    twice = {r["i"] + 6: r["x"] for r in blocks.unblocked(blocks.combined(v, 0.5, v)).collect()}
    assert len(twice) == 15 and all(abs(twice[i] - 1.5 * x[i]) < 1e-12 for i in range(15))


def test_restarts_reach_the_solution(spark, monkeypatch):
    monkeypatch.setattr(blocks, "WIDTH", 8)
    a = lattice(5)
    b = spark.createDataFrame([(i, float(i % 5 - 1)) for i in range(25)], "i long, x double")
    x, history = blocks.gmres(frame(spark, a), b, 5, 6, 1e-7)
    assert len(history) > 5 and history[-1] < 1e-7
    assert np.allclose([r["x"] for r in x.orderBy("i").collect()], np.linalg.solve(a, [i % 5 - 1 for i in range(25)]), atol=1e-6)
    zero, none = blocks.gmres(frame(spark, a), b.selectExpr("i", "0.0D AS x"), 5, 6, 1e-7)
    assert not none and [r["x"] for r in zero.collect()] == [0.0] * 25


def test_two_colours_iterate_on_one(spark, monkeypatch):
    monkeypatch.setattr(blocks, "WIDTH", 8)
    sizes = []
    monkeypatch.setattr(blocks, "of_basis", lambda t, *a, own=blocks.of_basis: sizes.append(t) or own(t, *a))
    a = lattice(4)
    df = frame(spark, a)
    two = df.select("i").distinct().selectExpr("i", "(i div 4 + i % 4) % 2 AS colour")
    b = spark.createDataFrame([(i, float(i % 5 - 1)) for i in range(16)], "i long, x double")
    x, history = blocks.gmres(df, b, 4, 5, 1e-8, reduced=precondition.two_colours(df, two))
    assert len(history) > 4 and history[-1] < 1e-8
    assert np.allclose([r["x"] for r in x.orderBy("i").collect()], np.linalg.solve(a, [i % 5 - 1 for i in range(16)]), atol=1e-7)
    assert sum(r["n"] for r in sizes[0].collect()) == 8


def test_the_basis_is_stored_once_an_iteration(spark, sf_dir, monkeypatch):
    stored = []
    for m in (blocks, solvers):
        monkeypatch.setattr(m, "cut", lambda df, own=m.cut: stored.append(df.columns) or own(df))
    seen = []
    monkeypatch.setattr(blocks, "gmres", lambda *a, own=blocks.gmres, **k: seen.append(own(*a, **k)) or seen[-1])
    QUERIES["incomplete_lu_solution"](spark, sf_dir)
    iterations = len(seen[0][1])
    assert 3 < iterations < 20 and sum("q" in columns for columns in stored) == iterations + 1
