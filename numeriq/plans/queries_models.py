"""Queries: nearest neighbours, estimators and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import estimators, factor, joins, medians, metric, prep
from ..streaming import streams
from .lineage import cut
from .registry import query, read


def points(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vec.doubles("embedding").alias("v"), "label").filter("v is not null")


def short(spark, sf_dir, n):
    return points(spark, sf_dir).select("id", F.slice("v", 1, n).alias("v"), "label")


KNN = """WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT q.id AS query_id, e.id, e.label, list_sum(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM e q JOIN e ON q.id % 25 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, id) AS rank FROM d)"""


@query(KNN + " SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(sqrt(d2), 8) AS distance FROM r WHERE rank <= 3")
def knn_topk(spark, sf_dir):
    return metric.knn(points(spark, sf_dir), F.col("id") % 25 == 0, 3).withColumn("distance", F.round("distance", 8))


@query(KNN + """, h AS (SELECT vec_id AS id, embedding[1:16] AS v FROM embeddings),
s AS (SELECT q.id AS query_id, h.id, row_number() OVER (PARTITION BY q.id ORDER BY list_sum(list_transform(list_zip(q.v, h.v), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))), h.id) AS n FROM h q JOIN h ON q.id % 25 = 0)
SELECT r.query_id, count(s.id) / 5.0 AS recall FROM r LEFT JOIN s ON s.query_id = r.query_id AND s.id = r.id AND s.n <= 5 WHERE r.rank <= 5 GROUP BY 1""")
def knn_recall(spark, sf_dir):
    """Recall of neighbours by the first 16 coordinates."""
    exact = metric.knn(points(spark, sf_dir), F.col("id") % 25 == 0, 5)
    found = metric.knn(short(spark, sf_dir, 16), F.col("id") % 25 == 0, 5)
    return joins.recall(found, exact, 5)


@query(KNN + """, v AS (SELECT query_id, label, count(*) AS n FROM r WHERE rank <= 5 GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS o FROM v) SELECT query_id, label AS prediction FROM w WHERE o = 1""")
def knn_classify(spark, sf_dir):
    p = points(spark, sf_dir)
    near = metric.knn(p, F.col("id") % 25 == 0, 5).join(p.select("id", "label"), "id")
    return joins.majority_vote(near, "label")


def kmeans_sql(k, dim, rounds):
    parts = [f"WITH p AS (SELECT vec_id AS id, list_transform(embedding[1:{dim}], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)",
             f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, v AS m FROM (SELECT * FROM p ORDER BY id LIMIT {k}))"]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT id, v, c, row_number() OVER (PARTITION BY id ORDER BY list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c) AS n, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM p, c{r})")
        if r < rounds:
            means = ", ".join(f"avg(v[{j + 1}])" for j in range(dim))
            zero = ", ".join(["0.0"] * dim)
            parts.append(f"c{r + 1} AS (SELECT c, coalesce(m, [{zero}]) AS m FROM (SELECT c FROM c0) LEFT JOIN (SELECT c, [{means}] AS m FROM d{r} WHERE n = 1 GROUP BY c) USING (c))")
    return ", ".join(parts), f"d{rounds}"


_KM, _LAST = kmeans_sql(4, 64, 2)
_DONE, _END = kmeans_sql(4, 64, 30)


@query(f"{_KM} SELECT id, CAST(c AS INTEGER) AS centre, round(d2, 8) AS d2 FROM {_LAST} WHERE n = 1")
def kmeans_two_rounds(spark, sf_dir):
    p = points(spark, sf_dir)
    centres, _ = estimators.kmeans(p, 4, 2)
    return joins.nearest_centre(p, centres).select("id", "centre", F.round("d2", 8).alias("d2"))


@query(f"{_DONE} SELECT round(sum(d2), 6) AS sse FROM {_END} WHERE n = 1")
def kmeans_inertia(spark, sf_dir):
    """What is left when no centre moves any more, or after 30 rounds."""
    p = points(spark, sf_dir)
    centres, _ = estimators.kmeans(p, 4, 30)
    return estimators.inertia(joins.nearest_centre(p, centres)).select(F.round("sse", 6).alias("sse"))


@query("SELECT label, j, round(avg(v), 8) AS m FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1, 2")
def group_mean_vectors(spark, sf_dir):
    m = estimators.mean_vectors(points(spark, sf_dir).withColumnRenamed("label", "g"), "g")
    return m.select(F.col("g").alias("label"), F.posexplode("centre").alias("j", "m")).select("label", F.col("j").cast("long").alias("j"), F.round("m", 8).alias("m"))


LATTICE = """WITH g AS (SELECT CAST(l_quantity AS BIGINT) AS x, CAST(round(l_tax * 100) * 7 + l_linenumber AS BIGINT) AS y, count(*) AS w FROM lineitem GROUP BY 1, 2),
n AS (SELECT a.x, a.y, a.w AS weight, CAST(sum(b.w) - 1 AS BIGINT) AS near FROM g a JOIN g b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4 GROUP BY 1, 2, 3)"""


def lattice(spark, sf_dir):
    x = F.col("l_quantity").cast("long").alias("x")
    return read(spark, sf_dir, "lineitem").select(x, (F.round(F.col("l_tax") * 100) * 7 + F.col("l_linenumber")).cast("long").alias("y"))


@query(LATTICE + " SELECT x, y, weight, near FROM n")
def range_join_counts(spark, sf_dir):
    return joins.lattice_neighbours(lattice(spark, sf_dir).withColumn("w", F.lit(1)), "x", "y", "w", 2)


def least_core(n):
    return max(5, n // 300)


@query(LATTICE.replace("WITH g", "WITH RECURSIVE g") + """, t AS (SELECT greatest(5, CAST(sum(w) AS BIGINT) // 300) AS k FROM g), c AS (SELECT x, y, x * 100000 + y AS id FROM n, t WHERE near >= k),
e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
l AS (SELECT a AS id, min(b) AS label FROM r GROUP BY a),
o AS (SELECT n.x, n.y, min(l.label) AS label FROM n JOIN c ON (n.x - c.x) * (n.x - c.x) + (n.y - c.y) * (n.y - c.y) <= 4 JOIN l ON l.id = c.id GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(l.label, o.label) AS label FROM n LEFT JOIN l ON l.id = n.x * 100000 + n.y LEFT JOIN o ON o.x = n.x AND o.y = n.y)
SELECT x, y, weight, near, (label // 100000) || ',' || (label % 100000) AS cluster FROM m""")
def lattice_clusters(spark, sf_dir):
    p = lattice(spark, sf_dir)
    return estimators.dbscan_lattice(p, "x", "y", 2, least_core(p.count()))


PAIRS = """e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT a.id AS a, b.id AS b, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM e a JOIN e b ON a.id <> b.id),
w AS (SELECT a, b, sqrt(d2) AS distance FROM d WHERE d2 <= 1.15 * 1.15)"""


@query(f"WITH {PAIRS} SELECT a AS id, b AS other, round(distance, 8) AS distance FROM w WHERE a < b")
def vector_range_join(spark, sf_dir):
    """Pairs of embeddings within a radius."""
    return metric.range_join(points(spark, sf_dir), 1.15).withColumn("distance", F.round("distance", 8))


@query(f"""WITH RECURSIVE {PAIRS}, n AS (SELECT e.id, count(w.b) AS near FROM e LEFT JOIN w ON w.a = e.id GROUP BY 1),
c AS (SELECT id FROM n WHERE near >= 4), x AS (SELECT a, b FROM w SEMI JOIN c ON c.id = w.a), y AS (SELECT a, b FROM x SEMI JOIN c ON c.id = x.b),
r(a, b) AS (SELECT id, id FROM c UNION SELECT r.a, y.b FROM r JOIN y ON r.b = y.a),
l AS (SELECT a AS id, min(b) AS label FROM r GROUP BY a),
o AS (SELECT w.a AS id, min(l.label) AS label FROM w JOIN l ON l.id = w.b GROUP BY 1)
SELECT n.id, n.near, coalesce(l.label, o.label) AS cluster FROM n LEFT JOIN l USING (id) LEFT JOIN o USING (id)""")
def density_clusters(spark, sf_dir):
    """Density clusters of the embeddings; a core row has four others within the radius."""
    return metric.dbscan(points(spark, sf_dir), 1.15, 4)


NB = ["l_quantity", "l_extendedprice", "l_discount"]


@query("SELECT l_returnflag, feature, round(n / t, 8) AS prior, round(m, 6) AS mean, round(v / 1e3, 6) AS variance FROM (" + " UNION ALL ".join(f"SELECT l_returnflag, '{f}' AS feature, count(*) AS n, (SELECT count(*) FROM lineitem) AS t, avg({f}) AS m, greatest(var_pop({f}), 1e-9) AS v FROM lineitem GROUP BY 1" for f in NB) + ")")
def class_statistics(spark, sf_dir):
    s = estimators.class_statistics(read(spark, sf_dir, "lineitem"), "l_returnflag", NB)
    return s.select("l_returnflag", "feature", F.round("prior", 8).alias("prior"), F.round("mean", 6).alias("mean"), F.round(F.col("variance") / 1e3, 6).alias("variance"))


@query("WITH l AS (SELECT *, row_number() OVER () AS id FROM lineitem), s AS (SELECT l_returnflag AS y, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lineitem) AS p, " + ", ".join(f"avg({f}) AS m{i}, greatest(var_pop({f}), 1e-9) AS v{i}" for i, f in enumerate(NB)) + " FROM lineitem GROUP BY 1), d AS (SELECT id, y, ln(p) + " + " + ".join(f"ln(exp(-(({f} - m{i}) * ({f} - m{i})) / (2 * v{i})) / sqrt(2 * pi() * v{i}))" for i, f in enumerate(NB)) + " AS s FROM l, s), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, y) AS n FROM d) SELECT y AS prediction, count(*) AS n FROM r WHERE n = 1 GROUP BY 1")
def naive_bayes_predictions(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *NB)  # noqa: E741
    return estimators.gaussian_naive_bayes(l, l, "l_returnflag", NB).groupBy("prediction").agg(F.count("*").alias("n"))


def tree_sql(base, features, depth, labels=None):
    """A tree grown level by level, each node by its best split: by variance, or by entropy of the counts of some labels."""
    sums = ["n", "s", "q"] if labels is None else [f"c{k}" for k in labels]
    agg = "count(*) AS n, sum(y) AS s, sum(y * y) AS q" if labels is None else ", ".join(f"count(*) FILTER (y = {k}) AS c{k}" for k in labels)

    def impurity(side):
        of = lambda c: f"({c}t - {c}l)" if side == "r" else f"{c}{side}"
        if labels is None:
            return f"({of('q')} / {of('n')} - pow({of('s')} / {of('n')}, 2))", of("n")
        total = "(" + " + ".join(map(of, sums)) + ")"
        return f"(log2({total}) - (" + " + ".join(f"CASE WHEN {of(c)} > 0 THEN {of(c)} * log2({of(c)}) ELSE 0 END" for c in sums) + f") / {total})", total

    sql = f"WITH n0 AS (SELECT *, 1 AS node FROM ({base}))"
    (it, nt), (il, nl), (ir, nr) = map(impurity, ("t", "l", "r"))
    for k in range(depth):
        values = " UNION ALL ".join(f"SELECT node, '{f}' AS feature, {f} AS value, {agg} FROM n{k} GROUP BY node, {f}" for f in features)
        run = ", ".join(f"sum({c}) OVER (PARTITION BY node, feature ORDER BY value) AS {c}l, sum({c}) OVER (PARTITION BY node, feature) AS {c}t" for c in sums)
        at = "CASE b.feature " + " ".join(f"WHEN '{f}' THEN n.{f}" for f in features) + " END"
        sql += f""", x{k} AS (SELECT node, feature, value, lead(value) OVER (PARTITION BY node, feature ORDER BY value) AS next, {run} FROM ({values})),
g{k} AS (SELECT node, feature, (value + next) / 2 AS t, {it} - {nl} / {nt} * {il} - {nr} / {nt} * {ir} AS gain FROM x{k} WHERE next IS NOT NULL),
b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 12) DESC, feature, t) AS o FROM g{k}) WHERE o = 1 AND gain > 1e-12),
n{k + 1} AS (SELECT n.* REPLACE (CASE WHEN b.node IS NULL THEN n.node WHEN {at} < b.t THEN 2 * n.node ELSE 2 * n.node + 1 END AS node) FROM n{k} n LEFT JOIN b{k} b ON b.node = n.node)"""
    return sql


@query(tree_sql("SELECT l_quantity, l_discount, l_tax, ascii(l_returnflag) AS y FROM lineitem", ["l_quantity", "l_discount", "l_tax"], 3, (65, 78, 82)) + """,
v AS (SELECT node, arg_max(y, (n, -y)) AS prediction FROM (SELECT node, y, count(*) AS n FROM n3 GROUP BY 1, 2) GROUP BY node) SELECT prediction, y, count(*) AS n FROM n3 JOIN v USING (node) GROUP BY 1, 2""")
def decision_tree(spark, sf_dir):
    """Predictions of a tree of depth 3 for the return flag, counted."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    nodes = estimators.fit_tree(l.withColumn("y", F.ascii("l_returnflag")), ["l_quantity", "l_discount", "l_tax"], "y", 3)
    return l.select(estimators.tree_column(nodes).alias("prediction"), F.ascii("l_returnflag").alias("y")).groupBy("prediction", "y").agg(F.count("*").alias("n"))


@query(tree_sql("SELECT l_quantity, l_discount, l_extendedprice AS y FROM lineitem", ["l_quantity", "l_discount"], 2) + ", v AS (SELECT node, round(avg(y), 4) AS prediction, count(*) AS n FROM n2 GROUP BY node) SELECT prediction, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY 1")
def regression_tree(spark, sf_dir):
    """Predictions of a tree of depth 2 for the price of an item, counted by leaf."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    nodes = estimators.fit_tree(l, ["l_quantity", "l_discount"], "l_extendedprice", 2, "variance")
    return l.select(F.round(estimators.tree_column(nodes), 4).alias("prediction")).groupBy("prediction").agg(F.count("*").alias("n"))


@query()
def random_forest(spark, sf_dir):
    """Votes of four trees on bootstrap samples, counted."""
    l = read(spark, sf_dir, "lineitem").withColumn("y", F.ascii("l_returnflag")).withColumn("k", F.col("l_orderkey") * 8 + F.col("l_linenumber"))  # noqa: E741
    forest = estimators.fit_forest(l, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "y", "k", trees=4, depth=2)
    return l.select(estimators.forest_column(forest).alias("prediction"), "y").groupBy("prediction", "y").agg(F.count("*").alias("n"))


def stumps_sql(rounds):
    sql = "WITH r0 AS (SELECT l_quantity AS f1, l_discount AS f2, l_extendedprice / 1000 AS y, 1.0::DOUBLE / count(*) OVER () AS w, 0.0::DOUBLE AS total, 0.0::DOUBLE AS alphas FROM lineitem)"
    for k in range(rounds):
        sums = " UNION ALL ".join(f"SELECT '{n}' AS feature, {c} AS value, sum(w) AS w, sum(w * y) AS s, sum(w * y * y) AS q FROM r{k} GROUP BY {c}" for n, c in (("l_discount", "f2"), ("l_quantity", "f1")))
        run = ", ".join(f"sum({c}) OVER (PARTITION BY feature ORDER BY value) AS {c}l, sum({c}) OVER (PARTITION BY feature) AS {c}t" for c in "wsq")
        sql += f""", x{k} AS (SELECT feature, value, lead(value) OVER (PARTITION BY feature ORDER BY value) AS next, {run} FROM ({sums})),
b{k} AS (SELECT feature, (value + next) / 2 AS t, sl / wl AS a, (st - sl) / (wt - wl) AS b, qt - wl * pow(sl / wl, 2) - (wt - wl) * pow((st - sl) / (wt - wl), 2) AS loss FROM x{k} WHERE next IS NOT NULL ORDER BY loss, feature, t LIMIT 1),
p{k} AS (SELECT r{k}.*, CASE WHEN CASE feature WHEN 'l_quantity' THEN f1 ELSE f2 END < t THEN a ELSE b END AS p FROM r{k}, b{k}),
e{k} AS (SELECT max(abs(y - p)) AS most, 0.5 * ln(1 / (sum(w * abs(y - p)) / sum(w) / max(abs(y - p))) - 1) AS alpha FROM p{k}), v{k} AS (SELECT f1, f2, y, w * exp(alpha * abs(y - p) / most) AS w, total + alpha * p AS total, alphas + alpha AS alphas FROM p{k}, e{k}),
r{k + 1} AS (SELECT f1, f2, y, w / sum(w) OVER () AS w, total, alphas FROM v{k})"""
    return sql + f" SELECT round(avg(pow(y - total / alphas, 2)), 6) AS mse, round(var_pop(y), 6) AS variance, {rounds} AS stumps FROM r{rounds}"


@query(stumps_sql(3))
def adaboost_regression(spark, sf_dir):
    """Mean squared error of boosted stumps against that of the mean."""
    l = read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", (F.col("l_extendedprice") / 1000).alias("y"))  # noqa: E741
    model = estimators.adaboost(l, ["l_quantity", "l_discount"], "y", 3)
    return l.agg(F.round(F.avg(F.pow(F.col("y") - estimators.boosted_column(model), 2.0)), 6).alias("mse"), F.round(F.var_pop("y"), 6).alias("variance"), F.lit(len(model)).alias("stumps"))


@query()
def adaboost_tree_regression(spark, sf_dir):
    """Mean squared error of boosted trees of depth two against that of the mean."""
    l = cut(read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", (F.col("l_extendedprice") / 1000).alias("y")))  # noqa: E741
    model = estimators.adaboost_trees(l, ["l_quantity", "l_discount"], "y", 3)
    return l.agg(F.round(F.avg(F.pow(F.col("y") - estimators.boosted_trees_column(model), 2.0)), 6).alias("mse"), F.round(F.var_pop("y"), 6).alias("variance"), F.lit(len(model)).alias("trees"))


def vector_machine_sql(scaled, target, epochs, sign, step_w, step_b, result):
    scale = lambda c: f"(l_{c} - avg(l_{c}) OVER ()) / stddev_pop(l_{c}) OVER ()"
    sql = f"WITH p AS (SELECT {scale('quantity')} AS x1, {scale('discount')} AS x2, {target.format(price=scale('extendedprice') if scaled else 'l_extendedprice')} AS y FROM lineitem), g0 AS (SELECT 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS b)"
    for k in range(epochs):
        new = [f"any_value(w{j}) - {step_w.format(w=f'any_value(w{j})', g=f'avg(s * x{j})')} AS w{j}" for j in (1, 2)]
        sql += f", g{k + 1} AS (SELECT {', '.join(new)}, any_value(b) + {step_b} * avg(s) AS b FROM (SELECT *, {sign} AS s FROM p, g{k}))"
    return sql + f" SELECT {result} FROM p, g{epochs}"


@query(vector_machine_sql(True, "{price}", 10, "CASE WHEN y - (w1 * x1 + w2 * x2 + b) > 0.1 THEN 1.0 WHEN y - (w1 * x1 + w2 * x2 + b) < -0.1 THEN -1.0 ELSE 0.0 END", "0.2 * ({w} - {g})", 0.2,
    "round(1 - sum(pow(y - (w1 * x1 + w2 * x2 + b), 2)) / sum(pow(y, 2)), 6) AS r2"))
def linear_svr(spark, sf_dir):
    """R2 of a linear support-vector regression of scaled price on scaled quantity."""
    l = prep.standard_scale(read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice"), ["l_quantity", "l_discount", "l_extendedprice"])  # noqa: E741
    rows = l.select(F.array("l_quantity", "l_discount").alias("v"), F.col("l_extendedprice").alias("y"))
    w, b = estimators.support_vector_regression(rows, "v", "y", 10, 0.2)
    p = vec.linear_score(F.array(*map(F.lit, w)), F.col("v"), F.lit(b))
    return rows.agg(F.round(1 - F.sum(F.pow(F.col("y") - p, 2.0)) / F.sum(F.pow("y", 2.0)), 6).alias("r2"))


@query(vector_machine_sql(False, "CASE WHEN {price} > 40000 THEN 1 ELSE -1 END", 8, "CASE WHEN y * (w1 * x1 + w2 * x2 + b) < 1 THEN y ELSE 0 END", "0.5 * ({w} / count(*) - {g})", 0.5,
    "round(avg(CASE WHEN (w1 * x1 + w2 * x2 + b >= 0) = (y > 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy"))
def linear_svm(spark, sf_dir):
    """Accuracy of a linear support-vector classifier for large orders."""
    l = prep.standard_scale(read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice"), ["l_quantity", "l_discount"])  # noqa: E741
    rows = l.select(F.array("l_quantity", "l_discount").alias("v"), F.when(F.col("l_extendedprice") > 40000, 1).otherwise(-1).alias("y"))
    w, b = estimators.support_vector_classifier(rows, "v", "y", 8, 0.5)
    s = vec.linear_score(F.array(*map(F.lit, w)), F.col("v"), F.lit(b))
    return rows.agg(F.round(F.avg(((s >= 0) == (F.col("y") > 0)).cast("double")), 6).alias("accuracy"))


def mixture_sql(k, rounds):
    sql = f"""WITH p AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
f AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT DISTINCT id FROM p ORDER BY id LIMIT {k})), c0 AS (SELECT k, j, x AS m, 1.0::DOUBLE AS s, 1.0::DOUBLE / {k} AS w FROM f JOIN p USING (id))"""
    for r in range(rounds):
        sql += f""", l{r} AS (SELECT id, k, any_value(ln(w)) + sum(-(x - m) * (x - m) / (2 * s) - ln(s * 2 * pi()) / 2) AS l FROM p JOIN c{r} USING (j) GROUP BY 1, 2),
e{r} AS (SELECT id, k, exp(l - max(l) OVER (PARTITION BY id)) AS e FROM l{r}), r{r} AS (SELECT id, k, e / sum(e) OVER (PARTITION BY id) AS r FROM e{r}),
c{r + 1} AS (SELECT k, j, sum(r * x) / sum(r) AS m, greatest(1e-6, sum(r * x * x) / sum(r) - pow(sum(r * x) / sum(r), 2)) AS s, sum(r) / (SELECT count(DISTINCT id) FROM p) AS w FROM r{r} JOIN p USING (id) GROUP BY 1, 2)"""
    return sql + f" SELECT CAST(k AS INTEGER) AS component, CAST(j AS INTEGER) AS j, round(w, 6) AS weight, round(m, 6) AS mean, round(s, 6) AS variance FROM c{rounds}"


@query(mixture_sql(3, 6))
def gaussian_mixture(spark, sf_dir):
    """A mixture of three Gaussians with diagonal covariance over whole vectors, six rounds."""
    p = points(spark, sf_dir)
    starts = [[float(x) for x in r["v"]] for r in p.orderBy("id").limit(3).collect()]
    parts = estimators.gaussian_mixture(p, starts, 6, tolerance=0.0)
    rows = [(i, j, round(w, 6), round(x, 6), round(y, 6)) for i, (w, m, v) in enumerate(parts) for j, (x, y) in enumerate(zip(m, v))]
    return spark.createDataFrame(rows, "component int, j int, weight double, mean double, variance double")


@query()
def principal_components(spark, sf_dir):
    """Scores on the two leading components."""
    p = points(spark, sf_dir)
    mean, parts, _ = estimators.principal_components(p, "v", 2)
    return estimators.project(p, "v", mean, parts).select("id", F.transform("scores", lambda x: F.round(x, 6)).alias("scores"))


@query("WITH v AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), r AS (SELECT id, max_by(j - 1, x) AS place, round(sqrt(sum(x * x)), 8) AS norm FROM v GROUP BY id) SELECT id, CAST(place AS INTEGER) AS place, norm FROM r")
def vector_norms(spark, sf_dir):
    return points(spark, sf_dir).select("id", vec.argmax(F.col("v")).alias("place"), F.round(vec.norm(F.col("v")), 8).alias("norm"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    w = streams.windowed_counts(read(spark, sf_dir, "events"), "ts", ["event_type"], "value", "1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


#: Events arrive in files of four days; of ten, one is 3 hours and one is 9 days under way.
ARRIVED = """a AS (SELECT *, CAST(floor((epoch(ts) + CASE event_id % 10 WHEN 3 THEN 10800 WHEN 7 THEN 777600 ELSE 0 END) / 345600) AS BIGINT) AS part FROM events),
b AS (SELECT part, max(max(ts)) OVER (ORDER BY part) AS seen, row_number() OVER (ORDER BY part) AS i FROM a GROUP BY part),
w AS (SELECT part, coalesce(lag(seen, 2) OVER (ORDER BY i), TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR AS late, max(seen) OVER () - INTERVAL 1 HOUR AS last FROM b)"""


def arrived(spark, sf_dir):
    """The folder of the stream, and its schema."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    days = F.when(F.col("event_id") % 10 == 3, 10800).when(F.col("event_id") % 10 == 7, 777600).otherwise(0)
    part = F.floor((F.unix_micros("ts") / 1e6 + days) / 345600)
    return streams.arrivals(e, part), e.schema


@query(f"""WITH {ARRIVED}, k AS (SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, value, last, late FROM a JOIN w USING (part) WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > late)
SELECT start, event_type, start + INTERVAL 1 HOUR <= last AS closed, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY 1, 2, 3""")
def streamed_event_windows(spark, sf_dir):
    """The same by Structured Streaming from many files: state, a watermark, append mode; what comes too late is dropped."""
    path, schema = arrived(spark, sf_dir)
    w = streams.stream_windowed_counts(spark, path, schema, "ts", ["event_type"], "value", "1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "closed", "n", F.round("total", 4).alias("total"))


@query(f"""WITH {ARRIVED} SELECT count(*) AS arrived, count(*) FILTER (time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= late) AS dropped FROM a JOIN w USING (part)""")
def streamed_late_rows(spark, sf_dir):
    """How many rows of the stream came too late for their window."""
    path, schema = arrived(spark, sf_dir)
    w = streams.stream_windowed_counts(spark, path, schema, "ts", ["event_type"], "value", "1 hour")
    came = spark.read.schema(schema).parquet(path).agg(F.count("*").alias("arrived"))
    return came.withColumn("dropped", F.col("arrived") - w.agg(F.sum("n")).scalar())


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM s),
t AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, n)
SELECT user_id, start, n, total FROM t WHERE "end" <= (SELECT max(ts) - INTERVAL 10 DAY FROM events)""")
def streamed_sessions(spark, sf_dir):
    """Sessions of a stream that the watermark has closed; it waits for ten days, so nothing is late."""
    path, schema = arrived(spark, sf_dir)
    w = streams.stream_windowed_counts(spark, path, schema, "ts", ["user_id"], "value", "", late="10 days", gap="2 hours")
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query()
def streamed_clusters(spark, sf_dir):
    """Weighted centres of the stream of embeddings."""
    schema = read(spark, sf_dir, "embeddings").schema
    c = streams.stream_clusters(spark, f"{sf_dir}/embeddings.parquet*", schema, "embedding", 8, 12)
    return c.select("weight", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query()
def streamed_medians(spark, sf_dir):
    """Weighted medians of the embeddings, which stream in four files."""
    e = read(spark, sf_dir, "embeddings")
    path = streams.arrivals(e, F.pmod(F.xxhash64("vec_id"), F.lit(4)))
    c = streams.stream_clusters(spark, path, e.schema, "embedding", 8, 12)
    return c.select("id", "weight", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


GAIN = """e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT * FROM e WHERE id < 20), x AS (SELECT * FROM e WHERE id BETWEEN 20 AND 59),
dc AS (SELECT e.id, c.id AS centre, list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e, c),
own AS (SELECT id, min(d) AS cost, arg_min(centre, (d, centre)) AS centre FROM dc GROUP BY id),
ch AS (SELECT x.id AS candidate, own.centre, list_sum(list_transform(list_zip(e.v, x.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) - own.cost AS d FROM x, e JOIN own ON own.id = e.id),
s AS (SELECT candidate, centre, -sum(least(d, 0)) AS saved, 3 - sum(greatest(d, 0)) AS closing FROM ch GROUP BY 1, 2)"""


@query(f"WITH {GAIN} SELECT candidate, round(sum(saved) + sum(greatest(closing, 0)) - 3, 8) AS gain, count(*) FILTER (closing > 0) AS closes FROM s GROUP BY 1")
def facility_gains(spark, sf_dir):
    """What it would save to open each of forty rows as a centre beside twenty, if a centre costs 3, and how many would close for it."""
    import numpy as np

    p = points(spark, sf_dir)
    some = {r["id"]: r["v"] for r in p.filter("id < 60").collect()}
    held = medians.weighted_points(p.select("id", "v", F.lit(1.0).alias("weight")))
    names = [sorted(i for i in some if low <= i < high) for low, high in ((0, 20), (20, 60))]
    gain, closes = medians.opening_gains(held, *(np.array([some[i] for i in part]) for part in names), 3.0)
    return spark.createDataFrame([(i, round(float(g), 8), int(c.sum())) for i, g, c in zip(names[1], gain, closes)], "candidate long, gain double, closes long")


@query()
def particle_filter(spark, sf_dir):
    """Filtered values of each user's events."""
    return streams.particle_filter(read(spark, sf_dir, "events"), "user_id", "event_id", "value", particles=32, noise=5.0)


@query()
def streamed_particle_filter(spark, sf_dir):
    """The same from a stream of five files, with each user's particles in the state store."""
    e = read(spark, sf_dir, "events")
    path = streams.arrivals(e, F.floor(F.dayofmonth("ts") / 7))
    return streams.stream_particle_filter(spark, path, e.schema, "user_id", "event_id", "value", particles=32, noise=5.0)


@query()
def nystrom_features(spark, sf_dir):
    """Eight features of each vector from eight landmarks."""
    return estimators.nystrom_features(points(spark, sf_dir), "v", "id", 8).select("id", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@query()
def singular_values(spark, sf_dir):
    """The three largest singular values of the suppliers' matrix."""
    from .queries_numeric import matrix

    found = estimators.singular_values(cut(matrix(spark, sf_dir)), 3, 5, 1)
    return spark.createDataFrame([(i, round(x, 4)) for i, x in enumerate(found)], "place int, value double")


@query()
def low_rank_error(spark, sf_dir):
    """What three singular vectors leave of the suppliers' matrix."""
    from .queries_numeric import matrix

    a = cut(matrix(spark, sf_dir))
    u, values, v = factor.randomized_svd(a, 3)
    e = factor.reconstruction_error(a, u, values, v)
    return spark.createDataFrame([(round(e["frobenius"], 4), round(e["relative"], 8))], "frobenius double, relative double")


@query()
def projection_error(spark, sf_dir):
    """What two principal components leave of the embeddings."""
    p = points(spark, sf_dir)
    mean, parts, _ = estimators.principal_components(p, "v", 2)
    return factor.projection_error(p, "v", mean, parts).select(*[F.round(c, 8).alias(c) for c in ("mean_squared", "largest")])


@query("""WITH a AS (SELECT p_partkey AS id, 1.0::DOUBLE AS x, CAST(p_size AS DOUBLE) AS y, p_retailprice AS z FROM part),
q1 AS (SELECT id, x / sqrt(sum(x * x) OVER ()) AS q1, y, z FROM a), m1 AS (SELECT *, y - q1 * sum(q1 * y) OVER () AS y1, z - q1 * sum(q1 * z) OVER () AS z1 FROM q1),
q2 AS (SELECT *, y1 / sqrt(sum(y1 * y1) OVER ()) AS q2 FROM m1), m2 AS (SELECT *, z1 - q2 * sum(q2 * z1) OVER () AS z2 FROM q2), q3 AS (SELECT *, z2 / sqrt(sum(z2 * z2) OVER ()) AS q3 FROM m2)
SELECT id, round(q1, 8) AS q1, round(q2, 8) AS q2, round(q3, 8) AS q3 FROM q3""")
def qr_factor(spark, sf_dir):
    """The orthonormal factor of a constant, the size and the price of parts."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.lit(1.0), F.col("p_size").cast("double"), "p_retailprice").alias("v"))
    q, _ = factor.tall_skinny_qr(p)
    return q.select("id", *[F.round(F.col("q")[c], 8).alias(f"q{c + 1}") for c in range(3)])


@query("SELECT count(*) AS rows, 0.0::DOUBLE AS from_unit, 0.0::DOUBLE AS residual FROM embeddings WHERE embedding IS NOT NULL")
def qr_checks(spark, sf_dir):
    """The largest elements of Q'Q - I and A - QR for the embeddings: nothing, to ten digits."""
    p = points(spark, sf_dir)
    q, r = factor.tall_skinny_qr(p)
    q = cut(q)
    values = (q.count(), round(factor.orthogonality_error(q)["largest"], 10), round(factor.factor_residual(p, q, r)["largest"], 10))
    return spark.createDataFrame([values], "rows long, from_unit double, residual double")


@query()
def neural_network(spark, sf_dir):
    """Accuracy of a small network for large orders."""
    l = prep.standard_scale(read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice"), ["l_quantity", "l_discount"])  # noqa: E741
    rows = l.select(F.array("l_quantity", "l_discount").alias("v"), (F.col("l_extendedprice") > 40000).cast("int").alias("y"))
    p = estimators.fit_network(rows, "v", "y", 4, 2, 5)
    return rows.agg(F.round(F.avg((vec.argmax(estimators.network_outputs(p, "v")) == F.col("y")).cast("double")), 6).alias("accuracy"))
