import random

import numpy as np
import pytest

from numeriq.operators import graph, metric
from pyspark.sql import functions as F

SCHEMA = "id long, v array<double>, bin string"


def clustered(seed, n, dim, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim)) * 3
    v = centres[rng.integers(0, 7, n)] + rng.normal(size=(n, dim)) * spread
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(n + i, rows[3][1]) for i in range(40)]  # one vector many times
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)


def distances(rows):
    v = np.array([r[1] for r in rows])
    return np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))


@pytest.mark.parametrize("dim,bin_rows", [(3, 25), (12, 40), (3, None)])
def test_range_join_equals_all_pairs(spark, dim, bin_rows):
    rows = clustered(1, 300, dim)
    d = distances(rows)
    got = {(r["id"], r["other"]): r["distance"] for r in metric.range_join(frame(spark, rows), 0.2, bin_rows=bin_rows).collect()}
    want = {(i, j): d[i, j] for i in range(len(rows)) for j in range(i + 1, len(rows)) if d[i, j] <= 0.2}
    assert got.keys() == want.keys() and len(want) > 500
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("k,bin_rows", [(1, 30), (5, 30), (400, 30), (5, None)])
def test_nearest_neighbours_equal_all_pairs(spark, k, bin_rows):
    rows = clustered(2, 250, 6)
    d = distances(rows)
    got = {(r["query_id"], r["rank"]): r["id"] for r in metric.knn(frame(spark, rows), F.col("id") % 9 == 0, k, bin_rows=bin_rows).collect()}
    want = {(q, n + 1): i for q in range(0, len(rows), 9) for n, i in enumerate(sorted(range(len(rows)), key=lambda i: (round(d[q, i], 12), i))[:k])}
    assert got == want


def test_nearest_rows_are_sought_among_few_pairs():
    """A part answers a query with its k nearest rows and ties, not with all that are within an unbounded radius."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x, q = np.round(rng.normal(size=(3000, 3)), 1), np.round(rng.normal(size=(700, 3)), 1)
    rows = pa.table({"v": x.tolist()})
    batch = pa.RecordBatch.from_pydict({"v": q.tolist(), "radius": [np.inf] * 690 + [0.3] * 10})
    seen = 0
    for b, i, j, d2 in metric.near_pairs(rows, [batch], 4):
        own = np.array(b["v"].to_pylist())
        assert b.num_rows * len(x) <= metric.PAIRS and len(i) < 40 * b.num_rows
        for n, (at, radius) in enumerate(zip(own, b["radius"].to_pylist())):
            all_ = ((at - x) ** 2).sum(1)
            near = np.sort(all_)[3]
            assert set(np.flatnonzero((all_ < min(near, radius**2)))) <= set(j[i == n]) and (d2[i == n] <= min(near, radius**2) + 1e-7).all()
            assert set(np.flatnonzero(all_ == near)) <= set(j[i == n]) or near > radius**2
        seen += b.num_rows
    assert seen == 700


def test_bins_far_away_are_skipped(spark):
    rows = clustered(3, 700, 8, 0.01)
    data, cells = metric.indexed(metric.named(frame(spark, rows), "id", "v"), 50)
    sent = metric.routed(metric.as_queries(metric.named(frame(spark, rows), "id", "v"), 0.05), cells).count()
    assert sent < 0.35 * len(rows) * cells.parts.sum()
    assert data.groupBy("bin", "part").count().agg(F.max("count")).first()[0] < 120


def brute_clusters(rows, radius, least):
    d = distances(rows) <= radius
    near = d.sum(1) - 1
    core = near >= least
    cluster = {i: i for i in range(len(rows)) if core[i]}
    moved = True
    while moved:
        moved = False
        for i in cluster:
            low = min(cluster[j] for j in np.flatnonzero(d[i] & core))
            if low < cluster[i]:
                cluster[i], moved = low, True
    border = {i: min((cluster[j] for j in np.flatnonzero(d[i] & core)), default=None) for i in range(len(rows)) if not core[i]}
    return {i: (int(near[i]), cluster.get(i, border.get(i))) for i in range(len(rows))}


@pytest.mark.parametrize("bin_rows,radius,least", [(30, 0.12, 6), (None, 0.12, 6), (30, 0.1, 20), (30, 100.0, 3), (30, 1e-9, 3)])
def test_density_clusters_equal_brute_force(spark, bin_rows, radius, least):
    rows = clustered(4, 260, 4)
    odd = [(9001, None), (9002, [1.0, None, 2.0, 3.0]), (9003, [float("nan")] * 4)]
    got = {r["id"]: (r["near"], r["cluster"]) for r in metric.dbscan(frame(spark, rows + odd), radius, least, bin_rows=bin_rows).collect()}
    assert got == brute_clusters(rows, radius, least) | {i: (0, None) for i, _ in odd}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert metric.dbscan(empty, 1.0, 2).count() == metric.range_join(empty, 1.0).count() == metric.knn(empty, F.lit(True), 3).count() == 0


def test_distances_are_sought_in_single_precision_only_where_it_tells():
    rng = np.random.default_rng(8)
    for shift, size, radius in ((0, 1, 0.9), (1e6, 1, 0.9), (0, 1e-9, 1e-9), (3, 1e12, 1e12), (0, 1, 1e-3), (0, 1, 0.0), (0, 1, 1e200)):
        x = np.round(rng.normal(size=(700, 5)), 2) * size + shift
        near = metric.Near(x)
        limit = np.full(300, min(radius**2, 1e308)) if radius < 1e100 else np.full(300, np.inf)
        i, j, d2 = near.pairs(x[:300], limit)
        all_ = ((x[:300, None] - x[None]) ** 2).sum(2)
        assert list(zip(i, j)) == list(zip(*np.nonzero(all_ <= limit[:, None]))) and (d2 == all_[i, j]).all()
        assert (near.sides(x[:300], limit)[0].dtype == np.float32) == (radius not in (1e-3, 0.0, 1e200))
        some = np.arange(0, 700, 3)
        i, j, _ = near.pairs(x[:300], limit, some)
        assert set(zip(i, j)) == set(zip(*np.nonzero((all_ <= limit[:, None]) & np.isin(np.arange(700), some))))


def test_rows_that_are_tied_are_not_sought_again(monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 6)) * 0.3
    x[3990:] += 50
    asked = []
    monkeypatch.setattr(metric.Near, "pairs", lambda self, q, limit, among=None, own=metric.Near.pairs: asked.append(len(q) * len(self.x if among is None else among)) or own(self, q, limit, among))
    near, parent, core = metric.Near(x), np.arange(4000), np.arange(4000) % 50 != 7
    ends, tied = [], []
    for s in range(0, 4000, 500):
        limit = np.full(500, 0.5**2)
        i, j = metric.links(near, x[s : s + 500], limit, core[s : s + 500], parent)
        close = ((x[s : s + 500, None] - x[None]) ** 2).sum(2) <= 0.25
        for k in range(500):
            got = set(j[i == k])
            assert (len(got) == 1 and close[k, list(got)].all()) if core[s + k] else got == set(np.flatnonzero(close[k]))
        ends += np.nonzero(close)[0][core[s : s + 500][np.nonzero(close)[0]]].tolist()
        tied.append(close)
    assert sum(asked) < 4000 * 4000 / 2
    d = np.concatenate(tied)
    label = np.arange(4000)
    while True:
        # Rows near a core row are one cluster.
        low = np.where(d & core[:, None], label[None], 4000).min(1)
        new = np.where(core, np.minimum(label, low), 4000)
        new = np.minimum(label, np.where(d[core], new[core][:, None], 4000).min(0))
        if (new == label).all():
            break
        label = new

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    roots = np.array([root(k) for k in range(4000)])
    assert len(set(zip(roots, label))) == len(set(roots)) == len(set(label))


def test_few_bytes_of_much_work_are_dealt_to_all_cores(spark, monkeypatch):
    monkeypatch.setattr(metric, "DEALT_ROWS", 50)
    rows = metric.named(frame(spark, clustered(5, 300, 3)), "id", "v")
    data, cells = metric.indexed(rows, 200)
    seen = metric.met(data, metric.routed(metric.as_queries(rows, 100.0), cells), lambda held, batches: ([_ for _ in batches], iter([held.select(["id"]).to_batches()[0]]))[1], "id long", cells, True)
    assert "REPARTITION_BY_NUM" in seen._jdf.queryExecution().executedPlan().toString()
    deals = min(-(-metric.DEALS * spark.sparkContext.defaultParallelism // int(cells.parts.sum())), 340 // 50)
    assert deals > 1 and seen.count() == deals * 340


@pytest.mark.parametrize("local_rows", [0, 10**6])
def test_components(spark, local_rows):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), local_rows).collect()}
    low = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {x: r for x, r in low.items() if x != r}
