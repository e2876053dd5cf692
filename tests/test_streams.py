import numpy as np
import pytest

from numeriq.operators import medians
from numeriq.streaming import streams
from pyspark.sql import functions as F


def blobs(seed, n, weights=False):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0], [30, 0], [0, 30], [30, 30], [60, 0]], float)
    return [(i, (centres[i % 5] + rng.normal(size=2)).tolist(), float(rng.integers(1, 4)) if weights else 1.0) for i in range(n)]


def held(spark, rows, monkeypatch, local):
    if not local:
        monkeypatch.setattr(medians, "LOCAL_ROWS", 0)
    return medians.weighted_points(spark.createDataFrame(rows, "id long, v array<double>, weight double").repartition(3))


def d2(a, b):
    return ((np.array(a)[:, None] - np.array(b)[None]) ** 2).sum(2)


@pytest.mark.parametrize("local", [True, False])
def test_gain_is_the_change_of_cost(spark, monkeypatch, local):
    rows = blobs(1, 120, True)
    points = held(spark, rows, monkeypatch, local)
    x, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    centres, candidates, z = x[[0, 1, 6, 11]], x[[2, 3, 5, 16]], 40.0
    gain, closes = medians.opening_gains(points, centres, candidates, z)
    own = d2(x, centres).argmin(1)
    for m, c in enumerate(candidates):
        new = d2(x, [c])[:, 0]
        cost = d2(x, centres).min(1)
        for k in range(4):
            of = own == k
            assert closes[m, k] == (z > (w * (new - cost))[of & (new >= cost)].sum())
        moved = np.where((new < cost) | closes[m, own], new, cost)
        left = (~closes[m]).sum() + 1
        assert abs((w * cost).sum() + 4 * z - ((w * moved).sum() + left * z) - gain[m]) < 1e-6


@pytest.mark.parametrize("local", [True, False])
def test_opening_follows_the_sequence(spark, monkeypatch, local):
    monkeypatch.setattr(medians, "STEP_ROWS", 7)
    points = held(spark, blobs(2, 150, True), monkeypatch, local)
    table = sorted(points.table.collect(), key=lambda r: r["order"])
    want = []
    for r in table:
        near = d2([r["v"]], [v for _, v in want]).min() if want else np.inf
        if r["draw"] * 900.0 < r["weight"] * near:
            want.append((r["id"], r["v"]))
    assert [i for i, _ in medians.opened(points, 900.0)] == [i for i, _ in want] and len(want) > 3


@pytest.mark.parametrize("local", [True, False])
def test_medians_find_the_blobs(spark, monkeypatch, local):
    rows = blobs(3, 200)
    points = held(spark, rows, monkeypatch, local)
    found = medians.k_median(points, 5, 5)
    best = d2([r[1] for r in rows], [np.mean([r[1] for r in rows if r[0] % 5 == k], 0) for k in range(5)]).min(1).sum()
    assert len(found) == 5 and medians.cost_of(points, np.array([c for _, c in found])) < 1.6 * best
    drawn = medians.drawn_to_members(points, found)
    assert sum(w for *_, w in drawn) == 200 and abs(medians.cost_of(points, np.array([c for _, c, _ in drawn])) - best) < 1e-6
    assert len(medians.k_median(held(spark, rows[:4], monkeypatch, local), 3, 9)) == 4


def test_ids_go_on_over_the_batches_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(r[0], r[1]) for r in blobs(4, 400)], "id long, v array<double>")
    path = streams.arrivals(rows, F.floor(F.col("id") / 100), str(tmp_path / "s"))
    got = streams.stream_clusters(spark, path, rows.schema, "v", 5, 5).collect()
    every = rows.orderBy("id").collect()
    assert sorted(r["weight"] for r in got) == [80.0] * 5
    # A median's id is that of a row of its own blob, numbered over all batches.
    for r in got:
        assert np.abs(np.array(every[r["id"]]["v"]) - r["v"]).max() < 6


def test_windows_close_once_and_late_rows_are_dropped(spark, tmp_path):
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    parts = [[(5, 1.0), (50, 1.0)], [(130, 1.0), (10, 2.0)], [(300, 1.0), (20, 4.0)], [(310, 1.0), (15, 8.0), (290, 1.0)]]
    rows = [(p, at(m), v) for p, part in enumerate(parts) for m, v in part]
    df = spark.createDataFrame(rows, "part int, t string, x double").select("part", F.col("t").cast("timestamp").alias("t"), "x")
    path = streams.arrivals(df, F.col("part"), str(tmp_path / "w"))
    got = streams.stream_windowed_counts(spark, path, df.schema, "t", [], "x", "1 hour", late="30 minutes").collect()
    found = sorted((r["start"].hour, r["n"], r["total"], r["closed"]) for r in got)
    # Row 20 comes while its window isn't closed yet, by the rule that a batch goes by the batches before the last; row 15 is late.
    assert found in ([(0, 4, 8.0, True), (2, 1, 1.0, True), (4, 1, 1.0, False), (5, 2, 2.0, False)], [(0, 4, 8.0, True), (2, 1, 1.0, True), (4, 1, 1.0, True), (5, 2, 2.0, False)])


def test_particles_stay_between_batches(spark, tmp_path):
    rows = [(u, t, float(np.sin(t / 5 + u) * 10)) for u in range(6) for t in range(30)]
    df = spark.createDataFrame(rows, "u long, t long, x double")
    path = streams.arrivals(df, F.floor(F.col("t") / 8), str(tmp_path / "p"))
    batch = {(r["u"], r["t"]): r["estimate"] for r in streams.particle_filter(df, "u", "t", "x", particles=16).collect()}
    got = {(r["u"], r["t"]): r["estimate"] for r in streams.stream_particle_filter(spark, path, df.schema, "u", "t", "x", particles=16).collect()}
    assert got == batch and len(got) == 180
