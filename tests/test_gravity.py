import numpy as np
import pytest

from numeriq.operators import gravity


def bodies(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n // 2, 2)), rng.normal(size=(n - n // 2, 2)) * 0.1 + [8, 3]])
    x[:3] = x[5]  # equal positions
    m = rng.random(n) + 0.5
    v = rng.normal(size=(n, 2)) * 0.1
    rows = [(i, float(x[i, 0]), float(x[i, 1]), float(v[i, 0]), float(v[i, 1]), float(m[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, y double, vx double, vy double, m double").repartition(3), x, v, m


def pulls(x, m, softening=1e-3):
    d = x[None] - x[:, None]
    d2 = (d**2).sum(2) + softening
    other = (d**2).sum(2) > 0
    return (m[None, :, None] * d / (d2**1.5)[..., None]).sum(1), -(m[None] / np.sqrt(d2) * other).sum(1)


@pytest.mark.parametrize("leaf,deepest", [(4, 6), (1000, 3), (4, 0)])
def test_angle_nought_is_all_pairs(spark, leaf, deepest):
    df, x, _, m = bodies(spark, 90)
    got = gravity.gravity(df, 0.0, leaf=leaf, deepest=deepest).orderBy("id").collect()
    a, p = pulls(x, m)
    assert np.allclose([[r["ax"], r["ay"]] for r in got], a, atol=1e-9) and np.allclose([r["potential"] for r in got], p, atol=1e-9)


def test_far_cells_are_close_enough(spark):
    df, x, _, m = bodies(spark, 300)
    a, _ = pulls(x, m)
    got = np.array([[r["ax"], r["ay"]] for r in gravity.gravity(df, 0.5, leaf=4, deepest=7).orderBy("id").collect()])
    off = np.linalg.norm(got - a, axis=1)
    assert 0 < off.max() and off.mean() < 0.01 * np.linalg.norm(a, axis=1).mean()


def test_steps_keep_the_energy(spark):
    df, x, v, m = bodies(spark, 40)
    df = df.filter("id > 2")
    x, v, m = x[3:], v[3:], m[3:]
    moved = gravity.move(df, 0.002, 2, angle=0.0, softening=0.05)
    for _ in range(2):
        v = v + 0.001 * pulls(x, m, 0.05)[0]
        x = x + 0.002 * v
        v = v + 0.001 * pulls(x, m, 0.05)[0]
    got = moved.orderBy("id").collect()
    assert np.allclose([[r["x"], r["y"], r["vx"], r["vy"]] for r in got], np.hstack([x, v]), atol=1e-9)
    before, after = (sum(gravity.energy(b, softening=0.05).first()) for b in (df, moved))
    assert abs(after - before) < 1e-3 * abs(before)


def test_one_body_and_none(spark):
    df, *_ = bodies(spark, 10)
    assert gravity.gravity(df.limit(1)).first()["ax"] == 0.0 and gravity.gravity(df.limit(0)).count() == 0


def test_every_pair_is_summed_in_blocks(spark):
    df, x, _, m = bodies(spark, 120)
    sources = df.groupBy("x", "y").agg({"m": "sum"}).withColumnRenamed("sum(m)", "m")
    got = gravity.all_pairs(df.select("id", "x", "y", "m"), sources, 1e-3, targets=30, held=40).orderBy("id").collect()
    a, p = pulls(x, m)
    assert np.allclose([[r["ax"], r["ay"]] for r in got], a, atol=1e-9) and np.allclose([r["potential"] for r in got], p, atol=1e-9)


def test_no_table_of_pairs_is_broadcast_or_stored(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(gravity, "cut", lambda df, own=gravity.cut: stored.append(own(df)) or stored[-1])
    df, *_ = bodies(spark, 400)
    gravity.gravity(df, 0.0).count()
    assert sum(t.count() for t in stored) <= 2 * 400 + 4
