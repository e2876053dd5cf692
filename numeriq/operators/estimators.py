"""Estimators as iterated dataflows: each iteration is aggregates over the rows; only a model's parameters come to the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import gaussian_pdf
from ..functions.vectors import dot, linear_score
from ..plans.lineage import cut
from .graph import components
from .joins import lattice_edges, lattice_neighbours, meet, nearest_centre
from .sequences import best_split, split_scan

# --- clustering -------------------------------------------------------------------------------------------------------


def mean_vectors(points: DataFrame, by: str, vector_col: str = "v", weight: str | None = None) -> DataFrame:
    """(by, centre, n): the mean vector of each group, by one array-free aggregate over coordinates."""
    w = F.col(weight) if weight else F.lit(1.0)
    long = points.select(by, w.alias("w"), F.posexplode(vector_col).alias("j", "x"))
    each = long.groupBy(by, "j").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("m"), F.sum("w").alias("n"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("centre"), F.max("n").alias("n"))


def kmeans(points: DataFrame, k: int, iterations: int = 100, id_col: str = "id", vector_col: str = "v") -> tuple[list[tuple[int, list[float]]], int]:
    """(centres, iterations). Starts from the k rows of the smallest ids; a cluster that loses all points becomes the zero vector;
    stops when no centre moves."""
    first = points.select(id_col, vector_col).orderBy(id_col).limit(k).collect()
    centres = [(i, [float(x) for x in r[1]]) for i, r in enumerate(first)]
    dim = len(centres[0][1]) if centres else 0
    for step in range(iterations):
        means = mean_vectors(nearest_centre(points, centres, vector_col).select(F.col("centre").alias("cluster"), vector_col), "cluster", vector_col)
        found = {r["cluster"]: list(r["centre"]) for r in means.collect()}
        new = [(i, found.get(i, [0.0] * dim)) for i, _ in centres]
        if new == centres:
            return centres, step
        centres = new
    return centres, iterations


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("d2").alias("sse"))


def dbscan_lattice(df: DataFrame, x: str, y: str, radius: int, least: int) -> DataFrame:
    """(x, y, weight, near, cluster) of integer points. near counts other points within the radius; a point with at least `least` of them
    is core; cluster is the smallest core point (as text x,y) that is reachable, a border point's is the smallest of its core
    neighbours', and noise has none. The result doesn't depend on the order of rows."""
    grid = cut(lattice_neighbours(df.withColumn("__w", F.lit(1)), x, y, "__w", radius))
    core = grid.filter(F.col("near") >= least)
    edges = lattice_edges(core, x, y, radius).select(F.struct(x, y).alias("a"), F.struct(F.col("x2").alias(x), F.col("y2").alias(y)).alias("b"))
    roots = components(edges.filter("a < b")).select(F.col(f"node.{x}").alias(x), F.col(f"node.{y}").alias(y), "root")
    labels = cut(core.select(x, y).join(roots, [x, y], "left").select(x, y, F.coalesce("root", F.struct(x, y)).alias("label")))
    offsets = lattice_edges(grid, x, y, radius).join(labels.select(F.col(x).alias("x2"), F.col(y).alias("y2"), "label"), ["x2", "y2"]).groupBy(x, y).agg(F.min("label").alias("border"))
    named = grid.join(labels, [x, y], "left").join(offsets, [x, y], "left").withColumn("l", F.coalesce("label", "border"))
    return named.select(x, y, "weight", "near", F.when(F.col("l").isNotNull(), F.concat_ws(",", F.col(f"l.{x}"), F.col(f"l.{y}"))).alias("cluster"))


def gaussian_mixture(points: DataFrame, means: list[list[float]], iterations: int = 10, vector_col: str = "v", floor: float = 1e-6, tolerance: float = 1e-9) -> list[tuple[float, list[float], list[float]]]:
    """(weight, mean, variance) of each component with a diagonal covariance, by expectation maximisation from the given means, until none of them moves by the tolerance."""
    dim = len(means[0])
    parts = [(1.0 / len(means), m, [1.0] * dim) for m in means]
    for _ in range(iterations):
        logs = []
        for w, m, v in parts:
            terms = F.zip_with(F.zip_with(vector_col, F.array(*map(F.lit, m)), lambda a, b: a.cast("double") - b), F.array(*map(F.lit, v)), lambda d, s: -d * d / (2 * s) - F.log(s * 2 * math.pi) / 2)
            logs.append(F.aggregate(terms, F.lit(math.log(max(w, 1e-300))), lambda s, t: s + t))
        scored = points.select(vector_col, F.array(*logs).alias("l")).withColumn("top", F.array_max("l"))
        scored = scored.withColumn("e", F.transform("l", lambda x: F.exp(x - F.col("top")))).withColumn("s", F.aggregate("e", F.lit(0.0), lambda s, x: s + x))
        long = scored.select(vector_col, F.posexplode(F.transform("e", lambda x: x / F.col("s"))).alias("k", "r")).select("k", "r", F.posexplode(vector_col).alias("j", "x"))
        x = F.col("x").cast("double")
        sums = long.groupBy("k", "j").agg(F.sum("r").alias("n"), F.sum(F.col("r") * x).alias("s"), F.sum(F.col("r") * x * x).alias("q")).collect()
        total = sum(r["n"] for r in sums if r["j"] == 0)
        new = [[0.0, [0.0] * dim, [floor] * dim] for _ in parts]
        for r in sums:
            n = max(r["n"], 1e-12)
            new[r["k"]][0] = r["n"] / total
            new[r["k"]][1][r["j"]] = r["s"] / n
            new[r["k"]][2][r["j"]] = max(floor, r["q"] / n - (r["s"] / n) ** 2)
        moved = max(abs(a - b) for (_, old, _), (_, now, _) in zip(parts, new) for a, b in zip(old, now))
        parts = [tuple(p) for p in new]
        if moved < tolerance:
            break
    return parts


# --- classification ---------------------------------------------------------------------------------------------------


def class_statistics(df: DataFrame, label: str, features: list[str], floor: float = 1e-9) -> DataFrame:
    """(label, feature, prior, mean, variance)."""
    total = df.agg(F.count("*")).scalar()
    n = df.groupBy(label).agg(F.count("*").alias("n"), *[F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean"), F.greatest(F.var_pop(f), F.lit(floor)).alias("variance")).alias(f"__{f}") for f in features])
    return n.withColumn("total", total).select(label, (F.col("n") / F.col("total")).alias("prior"), F.inline(F.array(*[F.col(f"__{f}") for f in features])))


def gaussian_naive_bayes(train: DataFrame, test: DataFrame, label: str, features: list[str]) -> DataFrame:
    """test with prediction: the label of the largest log prior + sum of log densities, ties to the smallest label. The model has a row per class and feature."""
    model: dict = {}
    for r in class_statistics(train, label, features).collect():
        model.setdefault(r[label], (r["prior"], {}))[1][r["feature"]] = (r["mean"], r["variance"])
    scores = []
    for c in sorted(model):
        prior, by = model[c]
        s = F.lit(math.log(prior))
        for f in features:
            s = s + F.log(gaussian_pdf(F.col(f), F.lit(by[f][0]), F.lit(by[f][1])))
        scores.append(F.struct((-s).alias("s"), F.lit(c).alias("c")))
    return test.withColumn("prediction", F.array_min(F.array(*scores))["c"])


def fit_tree(df: DataFrame, features: list[str], label: str, depth: int = 3, impurity: str = "entropy", least_rows: int = 2, weight: str | None = None) -> list[dict]:
    """Nodes of a decision tree (node, feature, threshold, value), grown level by level: one job scores all splits of all nodes of a level.
    Values below the threshold go left (2 node), others right (2 node + 1)."""
    rows = df.withColumn("node", F.lit(1))
    nodes: list[dict] = []
    open_nodes = {1}
    value = None
    if impurity == "variance":
        value = F.sum(F.col(weight) * F.col(label)) / F.sum(weight) if weight else F.avg(label)
    for level in range(depth + 1):
        if value is None:
            counts = rows.groupBy("node", label).agg(F.count("*").alias("n"))
            at = counts.groupBy("node").agg(F.max_by(label, F.struct("n", -F.col(label))).alias("value"), F.sum("n").alias("rows"))
        else:
            at = rows.groupBy("node").agg(value.alias("value"), F.count("*").alias("rows"))
        leaves = {r["node"]: r for r in at.collect()}
        splits = {r["node"]: r for r in best_split(split_scan(rows, features, label, impurity, ["node"], weight), ["node"]).collect()} if level < depth else {}
        test = F.lit(None).cast("int")
        grown = set()
        for n in sorted(open_nodes & set(leaves)):
            s = splits.get(n)
            if s and s["gain"] > 1e-12 and leaves[n]["rows"] >= least_rows:
                nodes.append({"node": n, "feature": s["feature"], "threshold": s["threshold"], "value": leaves[n]["value"]})
                test = F.when(F.col("node") == n, F.when(F.col(s["feature"]) < s["threshold"], 2 * n).otherwise(2 * n + 1)).otherwise(test)
                grown |= {2 * n, 2 * n + 1}
            else:
                nodes.append({"node": n, "feature": None, "threshold": None, "value": leaves[n]["value"]})
        if not grown:
            break
        rows = rows.withColumn("node", test).filter("node is not null")
        open_nodes = grown
    return nodes


def tree_column(nodes: list[dict]) -> Column:
    """A tree's prediction as one expression."""
    by = {n["node"]: n for n in nodes}

    def at(n: int) -> Column:
        x = by[n]
        if x["feature"] is None or 2 * n not in by or 2 * n + 1 not in by:
            return F.lit(x["value"])
        return F.when(F.col(x["feature"]) < x["threshold"], at(2 * n)).otherwise(at(2 * n + 1))

    return at(1) if by else F.lit(None)


def fit_forest(df: DataFrame, features: list[str], label: str, key: str, trees: int = 10, depth: int = 3, impurity: str = "gini") -> list[list[dict]]:
    """Trees on bootstrap samples: a row is in a tree as often as a Poisson(1) draw, made by hashing its key, says. Each tree has
    floor(sqrt(p)) + 1 features."""
    out = []
    size = min(len(features), int(math.sqrt(len(features))) + 1)
    for t in range(trees):
        u = F.pmod(F.xxhash64(F.lit(t), key), F.lit(1 << 40)) / float(1 << 40)
        p, times = math.exp(-1), F.lit(0)
        total = 0.0
        for n in range(7):
            total += p / math.factorial(n)
            times = times + (u >= total).cast("int")
        sample = df.withColumn("__copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).drop("__copy")
        own = [features[(t * 7 + i * 3 + t // len(features)) % len(features)] for i in range(len(features))]
        own = list(dict.fromkeys(own + features))[:size]
        out.append(fit_tree(sample, own, label, depth, impurity))
    return out


def forest_column(forest: list[list[dict]], regression: bool = False) -> Column:
    """The mean of the trees, or their commonest vote (ties to the smallest)."""
    votes = F.array(*[tree_column(t) for t in forest])
    if regression:
        return F.aggregate(votes, F.lit(0.0), lambda s, x: s + x) / len(forest)
    counted = F.transform(F.array_distinct(votes), lambda v: F.struct((-F.size(F.filter(votes, lambda x: x == v))).alias("n"), v.alias("v")))
    return F.array_min(counted)["v"]


def adaboost(df: DataFrame, features: list[str], target: str, rounds: int = 5) -> list[tuple[float, str, float, float, float]]:
    """(alpha, feature, threshold, left, right) of stumps for regression: each round takes the stump of least weighted absolute loss, stops
    when that is 0.5 or more, and multiplies weights by exp(alpha * residual)."""
    rows = df.withColumn("w", F.lit(1.0) / df.agg(F.count("*")).scalar())
    model = []
    for _ in range(rounds):
        long = rows.select("w", F.col(target).cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select("w", "y", "x.*")
        sums = long.groupBy("feature", "value").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("q"))
        order = Window.partitionBy("feature").orderBy("value")
        up, all_ = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("feature")
        x = sums.withColumns({c + "l": F.sum(c).over(up) for c in "wsq"} | {c + "t": F.sum(c).over(all_) for c in "wsq"} | {"next": F.lead("value").over(order)}).filter("next is not null")
        left, right = F.col("sl") / F.col("wl"), (F.col("st") - F.col("sl")) / (F.col("wt") - F.col("wl"))
        loss = F.col("qt") - F.col("wl") * left * left - (F.col("wt") - F.col("wl")) * right * right
        best = x.select("feature", ((F.col("value") + F.col("next")) / 2).alias("t"), left.alias("a"), right.alias("b"), loss.alias("loss")).orderBy("loss", "feature", "t").first()
        if best is None:
            break
        prediction = F.when(F.col(best["feature"]) < best["t"], best["a"]).otherwise(best["b"])
        residual = F.abs(F.col(target) - prediction)
        error = rows.agg((F.sum(F.col("w") * residual) / F.sum("w") / F.nullif(F.max(residual), F.lit(0.0))).alias("e")).first()["e"] or 1e-10
        if error >= 0.5:
            break
        alpha = 0.5 * math.log((1 - error) / max(error, 1e-10))
        model.append((alpha, best["feature"], best["t"], best["a"], best["b"]))
        most = rows.agg(F.max(residual)).first()[0] or 1.0
        rows = cut(rows.withColumn("w", F.col("w") * F.exp(alpha * residual / most)))
        rows = rows.withColumn("w", F.col("w") / rows.agg(F.sum("w")).scalar())
    return model


def adaboost_trees(df: DataFrame, features: list[str], target: str, rounds: int = 5, depth: int = 2) -> list[tuple[float, list[dict]]]:
    """(alpha, tree) of regression trees on weighted rows, with the squared loss (residual / largest residual)^2. A tree's splits are the best of their node;
    rounds stop when the weighted loss is 0.5 or more, or nothing is left to learn. Weights are multiplied by exp(alpha * loss)."""
    rows = cut(df.select(*features, target).withColumn("w", F.lit(1.0)))
    model = []
    for _ in range(rounds):
        tree = fit_tree(rows, features, target, depth, "variance", weight="w")
        residual = F.abs(F.col(target) - tree_column(tree))
        most = rows.agg(F.max(residual)).first()[0]
        if not tree or most is None:
            break
        loss = F.pow(residual / (most or 1.0), 2.0)
        error = rows.agg(F.sum(F.col("w") * loss) / F.sum("w")).first()[0]
        if error >= 0.5:
            break
        alpha = 0.5 * math.log((1 - error) / max(error, 1e-10))
        model.append((alpha, tree))
        if error < 1e-10:
            break
        scaled = rows.withColumn("w", F.col("w") * F.exp(alpha * loss))
        total = scaled.agg(F.avg("w")).first()[0]
        rows = cut(scaled.withColumn("w", F.col("w") / total))
    return model


def boosted_trees_column(model: list[tuple[float, list[dict]]]) -> Column:
    """The mean of the trees by alpha."""
    total = sum(a for a, _ in model) or 1.0
    out = F.lit(0.0)
    for a, tree in model:
        out = out + (a / total) * tree_column(tree)
    return out


def boosted_column(model) -> Column:
    total = sum(a for a, *_ in model) or 1.0
    out = F.lit(0.0)
    for a, f, t, left, right in model:
        out = out + (a / total) * F.when(F.col(f) < t, left).otherwise(right)
    return out


def support_vector_regression(df: DataFrame, vector_col: str, target: str, epochs: int = 50, rate: float = 0.001, c: float = 1.0, epsilon: float = 0.1) -> tuple[list[float], float]:
    """Linear, epsilon-insensitive, by subgradients over all rows: one aggregate per epoch."""
    dim = df.agg(F.max(F.size(vector_col))).first()[0] or 0
    w, b = [0.0] * dim, 0.0
    for _ in range(epochs):
        e = F.col(target) - linear_score(F.array(*map(F.lit, w)), F.col(vector_col), F.lit(b))
        sign = F.when(e > epsilon, 1.0).when(e < -epsilon, -1.0).otherwise(0.0)
        g = df.withColumn("__s", sign).agg(F.count("*").alias("n"), F.sum("__s").alias("b"), *[F.sum(F.col("__s") * F.col(vector_col)[j]).alias(f"g{j}") for j in range(dim)]).first()
        w = [x - rate * (x - c * g[f"g{j}"] / g["n"]) for j, x in enumerate(w)]
        b += rate * c * g["b"] / g["n"]
    return w, b


def support_vector_classifier(df: DataFrame, vector_col: str, label: str, epochs: int = 50, rate: float = 0.1, c: float = 1.0) -> tuple[list[float], float]:
    """Linear, hinge loss, by subgradients over all rows; labels are -1 and 1."""
    dim = df.agg(F.max(F.size(vector_col))).first()[0] or 0
    w, b = [0.0] * dim, 0.0
    for _ in range(epochs):
        margin = F.col(label) * linear_score(F.array(*map(F.lit, w)), F.col(vector_col), F.lit(b))
        active = df.withColumn("__s", F.when(margin < 1, F.col(label).cast("double")).otherwise(0.0))
        g = active.agg(F.count("*").alias("n"), F.sum("__s").alias("b"), *[F.sum(F.col("__s") * F.col(vector_col)[j]).alias(f"g{j}") for j in range(dim)]).first()
        w = [x - rate * (x / g["n"] - c * g[f"g{j}"] / g["n"]) for j, x in enumerate(w)]
        b += rate * c * g["b"] / g["n"]
    return w, b


# --- decompositions ---------------------------------------------------------------------------------------------------


def gram_sums(points: DataFrame, vector_col: str):
    """(n, sums, X'X) as numpy, from partial sums of each task: p x p numbers per task and no row leaves it."""
    import numpy as np

    def partial(batches):
        import pandas as pd

        n, s, q = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                s, q, n = (x.sum(0) if s is None else s + x.sum(0)), (x.T @ x if q is None else q + x.T @ x), n + len(x)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.reshape(-1).tolist()]})

    parts = points.select(F.col(vector_col).alias("v")).mapInPandas(partial, "n long, s array<double>, q array<double>")
    cells = parts.select("n", F.posexplode(F.concat("s", "q")).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("at").collect()
    flat = np.array([c["x"] for c in cells])
    p = int((math.isqrt(1 + 4 * len(flat)) - 1) // 2)
    return (cells[0]["n"] if cells else 0), flat[:p], flat[p:].reshape(p, p)


def gram(points: DataFrame, vector_col: str, center: bool = True):
    """(mean, X'X / n), less the means' products if they are to be centred."""
    import numpy as np

    n, sums, products = gram_sums(points, vector_col)
    mean, q = sums / n, products / n
    return (mean, q - np.outer(mean, mean)) if center else (mean, q)


def principal_components(points: DataFrame, vector_col: str, k: int) -> tuple[list[float], list[list[float]], list[float]]:
    """(mean, components, variances): eigenvectors of the covariance, whose p x p numbers are all that the driver holds."""
    import numpy as np

    mean, cov = gram(points, vector_col)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    parts = [v * (1 if v[np.argmax(np.abs(v))] > 0 else -1) for v in vectors[:, order].T]
    return mean.tolist(), [v.tolist() for v in parts], values[order].tolist()


def project(points: DataFrame, vector_col: str, mean: list[float], components: list[list[float]]) -> DataFrame:
    x = F.zip_with(vector_col, F.array(*map(F.lit, mean)), lambda a, b: a.cast("double") - b)
    return points.withColumn("scores", F.array(*[dot(x, F.array(*map(F.lit, c))) for c in components]))


def tall_skinny_r(points: DataFrame, vector_col: str):
    """The R of a QR factorisation: each task factors what it holds, and the factors are factored again, pairwise by group; p x p numbers each."""
    import numpy as np

    def factor(batches):
        import pandas as pd

        r = None
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.asarray(v, np.float64).reshape(-1, dim) for v in pdf["v"]]).reshape(-1, dim)
                r = np.linalg.qr(x if r is None else np.vstack((r, x)), mode="r")
        if r is not None:
            yield pd.DataFrame({"v": [r.reshape(-1).tolist()]})

    dim = points.agg(F.max(F.size(vector_col))).first()[0]
    now = points.select(F.transform(vector_col, lambda x: x.cast("double")).alias("v")).mapInPandas(factor, "v array<double>")
    now = now.repartition(8).mapInPandas(factor, "v array<double>")
    rows = now.collect()  # at most 8 factors
    r = np.linalg.qr(np.vstack([np.array(x["v"]).reshape(-1, dim) for x in rows]), mode="r")
    return r * np.where(np.diag(r) < 0, -1, 1)[:, None]


def nystrom_features(points: DataFrame, vector_col: str, id_col: str, landmarks: int, ridge: float = 1e-6) -> DataFrame:
    """points with features whose inner products approximate those of the vectors: K(x, L) W^(-1/2), with landmarks chosen by hash and W
    regularised by its mean diagonal. The landmarks (a parameter's number of rows) are all that the driver holds."""
    import numpy as np

    rows = points.orderBy(F.xxhash64(id_col), id_col).limit(landmarks).select(vector_col).collect()
    x = np.array([[float(v) for v in r[0]] for r in rows])
    w = x @ x.T
    w += np.eye(len(w)) * (np.trace(w) / len(w) * ridge)
    values, vectors = np.linalg.eigh(w)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T
    maps = (x.T @ root).T
    return points.withColumn("features", F.array(*[dot(F.col(vector_col), F.array(*map(F.lit, m.tolist()))) for m in maps]))


def singular_values(a: DataFrame, k: int, oversample: int = 5, power: int = 1, seed: int = 3) -> list[float]:
    """The k largest singular values of a sparse matrix (i, j, v), by a random sketch and power iterations.

    The sketch's random numbers are hashes of column and place, so they are made where they are used; rows of tall factors are arrays,
    and only (k + oversample)^2 numbers reach the driver.
    """
    import numpy as np

    size = k + oversample

    def sums(df, by):
        return df.groupBy(by).agg(F.array(*[F.sum(F.col("v") * F.col("y")[c]) for c in range(size)]).alias("y"))

    def orthonormal(y):
        _, g = gram(y, "y", center=False)
        g = g * y.count()
        values, vectors = np.linalg.eigh(g)
        basis = vectors / np.sqrt(np.maximum(values, 1e-12 * max(values.max(), 1e-300)))
        return y.withColumn("y", F.array(*[dot(F.col("y"), F.array(*map(F.lit, basis[:, c].tolist()))) for c in range(size)]))

    unit = lambda c: F.pmod(F.xxhash64("j", F.lit(seed), F.lit(c)), F.lit(2001)) / 1000.0 - 1.0
    y = cut(orthonormal(cut(sums(a.withColumn("y", F.array(*[unit(c) for c in range(size)])), "i"))))
    for _ in range(power):
        z = cut(orthonormal(cut(sums(meet(a, y, "i", size), "j"))))
        y = cut(orthonormal(cut(sums(meet(a, z, "j", size), "i"))))
    z = cut(sums(meet(a, y, "i", size), "j"))
    _, g = gram(z, "y", center=False)
    return [float(x) for x in np.sqrt(np.maximum(0, np.linalg.eigvalsh(g * z.count())[::-1][:k]))]


def fit_network(df: DataFrame, vector_col: str, target: str, hidden: int = 8, outputs: int = 1, epochs: int = 20, rate: float = 0.5, momentum: float = 0.9, seed: int = 1) -> dict:
    """A network of one hidden layer of sigmoids: linear output for outputs = 1 (squared error), else a softmax over labels 0, 1, ...

    Gradients are over all rows: each task adds up those of its rows, and their sums make one step, with momentum.
    """
    import numpy as np

    dim = df.agg(F.max(F.size(vector_col))).first()[0]
    rng = np.random.default_rng(seed)
    shapes = {"w1": (dim, hidden), "b1": (hidden,), "w2": (hidden, outputs), "b2": (outputs,)}
    p = {k: rng.standard_normal(s) / math.sqrt(s[0]) if k[0] == "w" else np.zeros(s) for k, s in shapes.items()}
    speed = {k: np.zeros(s) for k, s in shapes.items()}
    rows = df.select(F.col(vector_col).alias("v"), F.col(target).cast("double").alias("t"))
    for _ in range(epochs):

        def partial(batches, p=p):
            import pandas as pd

            total, n = None, 0
            for pdf in batches:
                if not len(pdf):
                    continue
                x, t = np.stack(pdf["v"].to_numpy()).astype(np.float64), pdf["t"].to_numpy()
                h = 1 / (1 + np.exp(-(x @ p["w1"] + p["b1"])))
                o = h @ p["w2"] + p["b2"]
                if outputs == 1:
                    d = o - t[:, None]
                else:
                    d = np.exp(o - o.max(1, keepdims=True))
                    d /= d.sum(1, keepdims=True)
                    d[np.arange(len(t)), t.astype(int)] -= 1
                e = d @ p["w2"].T * h * (1 - h)
                g = np.concatenate([(x.T @ e).ravel(), e.sum(0), (h.T @ d).ravel(), d.sum(0)])
                total, n = g if total is None else total + g, n + len(x)
            if n:
                yield pd.DataFrame({"n": [n], "g": [total.tolist()]})

        cells = rows.mapInPandas(partial, "n long, g array<double>").select("n", F.posexplode("g").alias("at", "g")).groupBy("at").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).orderBy("at").collect()
        flat, at = np.array([c["g"] / c["n"] for c in cells]), 0
        for k, s in shapes.items():
            size = int(np.prod(s))
            speed[k] = momentum * speed[k] - rate * flat[at : at + size].reshape(s)
            p[k] = p[k] + speed[k]
            at += size
    return p


def network_outputs(p: dict, vector_col: str) -> Column:
    """The outputs as one array expression: a matrix-vector product and a sigmoid per layer."""
    x = F.col(vector_col)
    h = [1 / (1 + F.exp(-(dot(x, F.array(*map(F.lit, p["w1"][:, j].tolist()))) + float(p["b1"][j])))) for j in range(p["w1"].shape[1])]
    outs = []
    for o in range(p["w2"].shape[1]):
        s = F.lit(float(p["b2"][o]))
        for j, v in enumerate(h):
            s = s + v * float(p["w2"][j, o])
        outs.append(s)
    return F.array(*outs)
