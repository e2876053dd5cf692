import math
import random

import numpy as np
import pytest

from numeriq.functions import formats, scalars, vectors
from numeriq.operators import estimators, joins, metric, prep, sequences, series, solvers
from numeriq.plans import tuner
from numeriq.sources import tables
from numeriq.streaming import streams
from pyspark.sql import functions as F


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_quantize_equals_half_and_single(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal(3000) * 10.0 ** rng.integers(-12, 6, 3000), [0.0, -0.0, 65504, 65519, 65520, 1e30, 6e-8, 3e-8, 2.0**-24, 2.0**-25, 1.00048828125, 2049, 2051, float("inf"), float("nan")]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", formats.quantize("x", 5, 10).alias("h"), formats.quantize("x", 8, 23).alias("s"), formats.quantize("x", 11, 52).alias("d"), formats.quantize("x", F.lit(4), F.lit(3)).alias("c"))
    with np.errstate(over="ignore"):
        for r in df.collect():
            for got, want in ((r["h"], np.float16(r["x"])), (r["s"], np.float32(r["x"])), (r["d"], r["x"])):
                assert got == float(want) or math.isnan(got) and math.isnan(want), r
    one = spark.range(1).select(*[formats.quantize(F.lit(v), 4, 3).alias(f"a{i}") for i, v in enumerate((247.9, 248.0, 0.0009, -300.0, 17.0, 19.0))]).first()
    assert list(one) == [240.0, math.inf, 0.0, -math.inf, 16.0, 20.0]
    assert formats.by_precision("dspcbw") == ["w", "c", "b", "p", "s", "d"] and formats.wider("p", "b") == "b"


def test_digits(spark):
    df = spark.createDataFrame([(1.0, 1.0009, True), (1.0, 1.002, False), (0.0, 0.0005, True), (0.0, 0.01, False), (1.0, float("nan"), False), (1.0, None, False)], "r double, v double, ok boolean")
    assert all(r["ok"] == r["g"] for r in df.withColumn("g", formats.within_digits("r", "v", 3)).collect())


def test_scalars(spark):
    s = 5
    for _ in range(5):
        t = s * 1103515245 + 12345
        t = (t + 2**31) % 2**32 - 2**31
        t = int(math.fmod(t, 2147483647))
        assert spark.range(1).select(scalars.lcg_next(F.lit(s))).first()[0] == t
        s = t
    got = spark.createDataFrame([(x,) for x in (0.4, 0.5, 1.5, -0.4, -0.5, -1.6)], "x double").select(scalars.round_half_up(F.col("x")))
    assert [r[0] for r in got.collect()] == [0, 1, 2, 0, -1, -2]
    row = spark.range(1).select(scalars.diagonal_gaussian_pdf(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(4.0))), *scalars.givens(F.lit(3.0), F.lit(4.0)), scalars.sigmoid_derivative(F.lit(0.25))).first()
    assert abs(row[0] - math.exp(-1 / 8) / (2 * math.pi * 2)) < 1e-12 and (round(row[1], 9), round(row[2], 9), row[3]) == (0.6, -0.8, 0.1875)
    row = spark.range(1).select(scalars.comma_and(F.array(F.lit("a"))), scalars.comma_and(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), vectors.squared_distance_float(F.array(F.lit(0.1)), F.array(F.lit(0.4)))).first()
    assert row[0] == "a" and row[1] == "a, b and c" and abs(row[2] - 0.09) < 1e-6
    row = spark.range(1).select(scalars.box_muller(F.lit(0.5), F.lit(0.0)), scalars.pressure(F.lit(1.0), F.lit(2.0), scalars.speed_squared(scalars.velocity(F.lit(2.0), F.lit(2.0))))).first()
    assert abs(row[0] - math.sqrt(2 * math.log(2))) < 1e-12 and abs(row[1] - 0.6) < 1e-12


def test_fill_and_transforms(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id long, x double")
    assert sorted(column(prep.fill_missing(df, ["x"]), "x")) == [1.0, 2.0, 3.0] and sorted(column(prep.fill_missing(df, ["x"], "zero"), "x")) == [0.0, 1.0, 3.0]
    assert sum(math.isnan(x) for x in column(prep.fill_missing(df, ["x"], "nan"), "x")) == 1
    a, b = (column(prep.hash_shuffle(spark.range(50), "id", s), "id") for s in (1, 2))
    assert sorted(a) == sorted(b) == list(range(50)) and a != b and a == column(prep.hash_shuffle(spark.range(50), "id", 1), "id")


@pytest.fixture(scope="module")
def system(spark):
    rng = np.random.default_rng(3)
    n = 20
    m = rng.standard_normal((n, n)) * (rng.random((n, n)) < 0.3)
    m = m + m.T
    np.fill_diagonal(m, np.abs(m).sum(1) + 1)
    b = rng.standard_normal(n)
    a = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "i long, j long, v double")
    return m, b, a, spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "i long, x double")


def dense(x):
    return np.array([r["x"] for r in x.orderBy("i").collect()])


@pytest.mark.parametrize("solve", [lambda a, b: solvers.jacobi(a, b, 12, 0.0), lambda a, b: solvers.conjugate_gradient(a, b, 9), lambda a, b: solvers.bicgstab(a, b, 6), lambda a, b: solvers.gmres(a, b, 8, 2)])
def test_solvers(system, solve):
    m, b, a, right = system
    x, history = solve(a, right)
    assert np.abs(dense(x) - np.linalg.solve(m, b)).max() < 0.02 and history[-1] < history[0]


def test_red_black_and_refinement(system):
    m, b, a, right = system
    x = right.select("i", F.lit(0.0).alias("x"))
    y = np.zeros(len(b))
    for _ in range(2):
        x = solvers.red_black_sweep(a, right, x, 1.2)
        for colour in (0, 1):
            new = y.copy()
            for i in range(colour, len(b), 2):
                new[i] = -0.2 * y[i] + 1.2 * (b[i] - m[i] @ y + m[i, i] * y[i]) / m[i, i]
            y = new
    assert np.allclose(dense(x), y)
    x, history = solvers.refine(a, right, lambda a_, r: solvers.jacobi(a_, r, 4, 0.0)[0], 2, lambda c: formats.quantize(c, 8, 7))
    assert history[1] < history[0]


def test_kmeans_and_empty_cluster(spark):
    pts = [(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [9.0, 9.0]), (3, [9.0, 9.2]), (4, [0.0, 0.4])]
    centres, _ = estimators.kmeans(spark.createDataFrame(pts, "id long, v array<double>"), 3)
    found = dict(centres)
    assert found[2] == [9.0, 9.1] and np.allclose(found[0], [0.0, 0.4 / 3]) or found[1] == [0.0, 0.0]


def test_tree_forest_boosting(spark):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random()) for i in range(600)]
    rows = [(i, a, b, int(a > 0.6) + 2 * int(b > 0.3), 3 * a + b) for i, a, b in rows]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int, t double")
    for impurity in ("entropy", "gini"):
        tree = estimators.fit_tree(df, ["a", "b"], "y", 3, impurity)
        assert df.select(F.avg((estimators.tree_column(tree) == F.col("y")).cast("double"))).first()[0] == 1.0
    tree = estimators.fit_tree(df, ["a", "b"], "t", 3, "variance")
    assert df.select(F.avg(F.pow(estimators.tree_column(tree) - F.col("t"), 2.0)) / F.var_pop("t")).first()[0] < 0.15
    forest = estimators.fit_forest(df, ["a", "b"], "y", "k", 3, 3)
    assert df.select(F.avg((estimators.forest_column(forest) == F.col("y")).cast("double"))).first()[0] > 0.9
    model = estimators.adaboost(df, ["a", "b"], "t", 4)
    assert df.select(F.avg(F.pow(estimators.boosted_column(model) - F.col("t"), 2.0)) / F.var_pop("t")).first()[0] < 0.6
    rows = df.select(F.array("a", "b").alias("v"), F.when(F.col("a") > 0.5, 1).otherwise(-1).alias("y"), (F.col("a") * 2 + 0.5).alias("t"))
    w, b = estimators.support_vector_classifier(rows, "v", "y", 40, 1.0, 2.0)
    assert rows.select(F.avg(((vectors.linear_score(F.array(*map(F.lit, w)), F.col("v"), F.lit(b)) >= 0) == (F.col("y") > 0)).cast("double"))).first()[0] > 0.9
    w, b = estimators.support_vector_regression(rows, "v", "t", 60, 0.1, 5.0, 0.05)
    assert rows.select(F.avg(F.abs(vectors.linear_score(F.array(*map(F.lit, w)), F.col("v"), F.lit(b)) - F.col("t")))).first()[0] < 0.4


def test_mixture_pca_and_qr(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((150, 3)) + 5, rng.standard_normal((150, 3)) * 0.5 - 5])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    parts = estimators.gaussian_mixture(df, [[1.0, 1, 1], [-1.0, -1, -1]], 6)
    assert abs(parts[0][0] - 0.5) < 0.02 and np.allclose(parts[1][1], x[150:].mean(0), atol=0.1)
    mean, comps, values = estimators.principal_components(df, "v", 2)
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(values, want[:2]) and np.allclose(mean, x.mean(0))
    r = estimators.tall_skinny_r(df, "v")
    assert np.allclose(r.T @ r, x.T @ x) and np.allclose(r, np.triu(r))


def test_density_clusters_match_brute_force(spark):
    rng = random.Random(8)
    pts = [(rng.randrange(12), rng.randrange(12)) for _ in range(90)]
    got = {(r["x"], r["y"]): r for r in estimators.dbscan_lattice(spark.createDataFrame(pts, "x long, y long"), "x", "y", 1, 3).collect()}
    near = {p: sum((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 1 for q in pts) - 1 for p in set(pts)}
    core = {p for p in near if near[p] >= 3}
    label = {p: p for p in core}
    for _ in range(200):
        for p in core:
            label[p] = min(label[q] for q in core if abs(p[0] - q[0]) ** 2 + abs(p[1] - q[1]) ** 2 <= 1)
    for p in near:
        border = [label[q] for q in core if abs(p[0] - q[0]) ** 2 + abs(p[1] - q[1]) ** 2 <= 1]
        want = label.get(p) or (min(border) if border else None)
        assert got[p]["near"] == near[p] and got[p]["cluster"] == (f"{want[0]},{want[1]}" if want else None)


def test_spline_and_trapezoid(spark):
    xs = [0.0, 1.0, 2.5, 4.0, 5.0]
    k = spark.createDataFrame([(1, x, math.sin(x)) for x in xs], "g int, x double, y double")
    m = {r["x"]: r["m"] for r in series.spline_second_derivatives(k, ["g"], "x", "y").collect()}
    h = np.diff(xs)
    a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
    want = np.linalg.solve(a, 6 * np.diff(np.diff(np.sin(xs)) / h))
    assert np.allclose([m[x] for x in xs], [0, *want, 0])
    y = spark.range(1).select(series.trapezoid(F.array(F.lit(1.0), F.lit(2.0)), 0.05, 2).alias("y")).first()["y"]
    t = np.array([[-2.0, 1.0], [1.0, -2.0]])
    s = np.linalg.solve(np.eye(2) - 0.025 * t, np.eye(2) + 0.025 * t)
    assert np.allclose(y, s @ s @ [1.0, 2.0], atol=1e-5)


def test_tuner_equals_all_subsets(spark):
    assert tuner.split_parts(list(range(7)), 3) == [[0, 1], [2, 3], [4, 5, 6]]
    good = [{1, 2, 4}, {0, 3}]
    passes = lambda s: any(s <= g for g in good)
    found = set(tuner.largest_passing([0, 1, 2, 3, 4], passes))
    assert passes(found) and all(not passes(found | {x}) for x in set(range(5)) - found)
    df = spark.createDataFrame([(i % 3, i / 7, float(i % 5), 1 / (i + 1)) for i in range(60)], "g int, a double, b double, c double")
    query = lambda d: d.groupBy("g").agg(F.sum(F.col("a") + F.col("b") * 0.0).alias("s"), F.sum("b").alias("t"))
    t = tuner.tune(df, query, ["a", "b", "c"], ["g"], ["s", "t"], 5, "psd")
    assert t.formats["b"] == "p" and t.formats["c"] == "p" and t.formats["a"] == "s" and t.runs >= 2 and t.by_format()["p"] == {"b", "c"}


def test_sources_round_trip(spark, tmp_path):
    p = tmp_path / "points.csv"
    p.write_text("idx,a,b,label\n0,1.5,NA,0\n1,2.5,4,1\n")
    got = sorted((r["id"], list(r["v"]), r["label"]) for r in tables.read_points(spark, str(p), missing="mean").collect())
    assert got == [(0, [1.5, 4.0], 0.0), (1, [2.5, 4.0], 1.0)]
    m = tmp_path / "m.mtx"
    m.write_text("%%MatrixMarket matrix coordinate real symmetric\n% c\n3 3 4\n1 1 2.0\n2 1 -1\n3 3 5\n3 2 0.5\n")
    a = tables.read_matrix_market(spark, str(m))
    assert sorted(map(tuple, a.collect())) == [(0, 0, 2.0), (0, 1, -1.0), (1, 0, -1.0), (1, 2, 0.5), (2, 1, 0.5), (2, 2, 5.0)]
    assert joins.is_symmetric(a).first()["unmatched"] == 0
    g = tmp_path / "grid.txt"
    g.write_text("\n".join(str(i) for i in range(6)))
    assert sorted(map(tuple, tables.read_grid(spark, str(g), 3).collect())) == [(i // 3, i % 3, float(i)) for i in range(6)]
    (tmp_path / "f.bin").write_bytes(np.arange(9, dtype="<f4").tobytes())
    assert sorted((r["block"], list(r["v"])) for r in tables.read_float_blocks(spark, str(tmp_path / "f.bin"), 2).collect()) == [(i, [2.0 * i, 2.0 * i + 1]) for i in range(4)]
    (tmp_path / "s.json").write_text('[{"float": ["a", "b"]}, {"double": ["a"], "float": ["b"]}]')
    s = tables.read_settings(spark, str(tmp_path / "s.json"))
    assert sorted(map(tuple, tuner.format_counts(s).collect())) == [(1, "float", 2), (2, "double", 1), (2, "float", 1)]
    (tmp_path / "r.csv").write_text("Digit,Runtime (seconds)\n1,2.0\n2,4.0\nAverage,3.0\n")
    r = tables.read_runtimes(spark, str(tmp_path / "r.csv"))
    assert {tuple(x) for x in tuner.runtime_summary(r).collect()} == {(1, 2.0), (2, 4.0), (None, 3.0)}
    (tmp_path / "fp.json").write_text('{"s": [8, 23], "c": [4, 3]}')
    assert [tuple(x) for x in tables.read_formats(spark, str(tmp_path / "fp.json")).collect()] == [("c", 4, 3), ("s", 8, 23)]
    tables.write_points(spark.createDataFrame([([1.0, 2.0], 3)], "v array<double>, label int"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["feature_0", "feature_1", "label"]
    tables.write_matrix(a, str(tmp_path / "mat"))
    tables.write_solution(spark.createDataFrame([(0, 1.0)], "i long, x double"), [0.5], str(tmp_path / "sol"))
    tables.write_runtimes(r, str(tmp_path / "rt"))
    tables.write_settings(s, str(tmp_path / "set"))
    assert sorted(x["v"] for x in tables.read_matrix(spark, str(tmp_path / "mat")).collect())[0] == -1.0
    assert tables.synthetic_points(spark, 5, 2).count() == 5 and tables.synthetic_dominant(spark, 6).filter("i = j").count() == 6


def test_stream_clusters_find_centres(spark, tmp_path):
    rng = np.random.default_rng(1)
    true = np.array([[0.0, 0], [50, 0], [0, 50]])
    rows = [(i, [float(x) for x in true[i % 3] + rng.standard_normal(2)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    df.write.parquet(str(tmp_path / "s"))
    got = streams.stream_clusters(spark, str(tmp_path / "s"), df.schema, "v", 3, 3).collect()
    assert sum(r["weight"] for r in got) == 300 and len(got) == 3
    assert all(min(np.abs(np.array(r["v"]) - t).max() for r in got) < 1 for t in true)


def test_sequences(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "id long, x double")
    got = {r["id"]: r["total"] for r in sequences.running_total(df, ["id"], "x", 9).collect()}
    total = 0
    for i in range(200):
        total += i % 7
        assert got[i] == total
    assert sequences.running_total(df.limit(0), ["id"], "x").count() == 0


def test_network_learns(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 2))
    df = spark.createDataFrame([([float(a), float(b)], int(a * b > 0), float(np.tanh(a))) for a, b in x], "v array<double>, y int, t double")
    p = estimators.fit_network(df, "v", "y", 8, 2, 60, 1.5)
    assert df.select(F.avg((vectors.argmax(estimators.network_outputs(p, "v")) == F.col("y")).cast("double"))).first()[0] > 0.85
    p = estimators.fit_network(df, "v", "t", 4, 1, 30, 0.3)
    assert df.select(F.avg(F.pow(estimators.network_outputs(p, "v")[0] - F.col("t"), 2.0)) / F.var_pop("t")).first()[0] < 0.2


def test_singular_values_and_nystrom(spark, system):
    m, _, a, _ = system
    got = estimators.singular_values(a, 2, 8, 2)
    assert np.allclose(got, np.linalg.svd(m, compute_uv=False)[:2], rtol=1e-3)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 3)) @ rng.standard_normal((3, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    f = np.array([r["features"] for r in estimators.nystrom_features(df, "v", "id", 10, 1e-9).orderBy("id").collect()])
    assert np.allclose(f @ f.T, x @ x.T, atol=1e-2)


def test_multigrid_beats_smoothing(spark):
    f = spark.createDataFrame([(r, c, 1.0) for r in range(8) for c in range(8)], "r long, c long, v double")
    zero = f.withColumn("v", F.lit(0.0))
    size = lambda u: series.residual(u, f).agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0]
    assert size(series.v_cycle(zero, f, 3)) < 0.75 * size(series.smooth(zero, f, 4))


def test_simpson(spark):
    y = spark.range(1).select(series.simpson(F.array(F.lit(1.0), F.lit(2.0)), 0.02, 5, 8).alias("y")).first()["y"]
    t = np.array([[-2.0, 1.0], [1.0, -2.0]])
    values, vectors_ = np.linalg.eigh(t)
    want = vectors_ @ np.diag(np.exp(values * 0.2)) @ vectors_.T @ [1.0, 2.0]
    assert np.allclose(y, want, atol=2e-3)


def test_hexadecimal_dump_lines(spark):
    values = [1.0, -0.1, 3.5e-300, 123456789.123, 0.0]
    lines = [f"[DUMP] x[{i}] = {v.hex()}" for i, v in enumerate(values)] + ["[DUMP] y = 0x1p-3", "nothing here"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(scalars.dump_line(F.col("t"))).collect()]
    assert [(r["name"], r["place"], r["value"]) for r in got] == [("x", i, v) for i, v in enumerate(values)] + [("y", None, 0.125), (None, None, None)]
    assert spark.range(1).select(scalars.options_map(F.lit("a=1 b=x"))).first()[0] == {"a": "1", "b": "x"}


def test_groups_are_bounded_on_large_and_repeated_rows(spark):
    rows = [(i, [float(i * i % 97), float(i % 13)]) for i in range(700)]
    data = spark.createDataFrame(rows, "id long, v array<double>")
    near = metric.knn(data, F.col("id") % 50 == 0, 3, bin_rows=5).collect()
    want = {(q, i) for q, x in rows if q % 50 == 0 for i in [j for _, j in sorted((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in rows)[:3]]}
    assert {(r["query_id"], r["id"]) for r in near} == want
