import numpy as np

from numeriq.functions import formats
from numeriq.operators import estimators
from pyspark.sql import functions as F


def best(x, y, w):
    """The best weighted split of some rows: (feature, threshold), or None."""
    found = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] < t
            loss = sum((w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum() for s in (left, ~left))
            if found is None or loss < found[0] - 1e-9:
                found = (loss, f, t)
    return found and found[1:]


def boosted(x, y, rounds):
    w, trees = np.ones(len(y)), []
    for _ in range(rounds):
        f, t = best(x, y, w)
        p = np.zeros(len(y))
        for side in (x[:, f] < t, x[:, f] >= t):
            split = best(x[side], y[side], w[side])
            parts = [side & (x[:, split[0]] < split[1]), side & (x[:, split[0]] >= split[1])] if split else [side]
            for s in parts:
                p[s] = np.average(y[s], weights=w[s])
        r = np.abs(y - p)
        loss = (r / r.max()) ** 2
        error = (w * loss).sum() / w.sum()
        if error >= 0.5:
            break
        alpha = 0.5 * np.log((1 - error) / error)
        trees.append((alpha, p))
        w = w * np.exp(alpha * loss)
        w = w / w.mean()
    return sum(a * p for a, p in trees) / sum(a for a, _ in trees)


def test_boosted_trees_equal_a_plain_version(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.random((150, 2)) * 12)
    y = np.where(x[:, 0] > 5, 3 * x[:, 1], 20 - x[:, 0]) + rng.normal(size=150)
    df = spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    model = estimators.adaboost_trees(df, ["a", "b"], "y", 3)
    got = [r["p"] for r in df.select("id", estimators.boosted_trees_column(model).alias("p")).orderBy("id").collect()]
    assert len(model) == 3 and np.allclose(got, boosted(x, y, 3), atol=1e-9)
    assert np.mean((np.array(got) - y) ** 2) < 0.5 * y.var()


def test_single_precision_is_that_of_the_rule(spark):
    values = [0.1, -1e-42, 1e-46, 3.4028235e38, 3.5e38, -1e300, 1 + 2.0**-24, 1 + 3 * 2.0**-24, 0.0, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select(formats.quantize("x", 8, 23).alias("a"), formats.quantize("x", F.lit(8), F.lit(23)).alias("b")).collect()
    assert [repr(r["a"]) for r in rows] == [repr(r["b"]) for r in rows]
