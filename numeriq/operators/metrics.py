"""Aggregates that judge clusterings, classifications, regressions and factorisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy(df: DataFrame, label: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Bits, from counts by label."""
    n = df.groupBy(*by, label).agg(F.count("*").cast("double").alias("n"))
    return n.groupBy(*by).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def gini(df: DataFrame, label: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    n = df.groupBy(*by, label).agg(F.count("*").cast("double").alias("n"))
    return n.groupBy(*by).agg((1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("gini"))


def contingency(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts by both labels with all marginals; a null stands for a sum over the label."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n")).cube("truth", "predicted").agg(F.sum("n").alias("n"))


def _table(df: DataFrame, truth: str, predicted: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))
    return n, n.groupBy("t").agg(F.sum("n").alias("a")), n.groupBy("p").agg(F.sum("n").alias("b"))


def adjusted_rand_index(df: DataFrame, truth: str, predicted: str, shift: float = 0.0) -> DataFrame:
    n, a, b = _table(df, truth, predicted)
    pairs = lambda x: F.sum(F.col(x) * (F.col(x) - 1) / 2)
    one = n.agg(pairs("n").alias("both"), F.sum("n").alias("n"))
    x = one.withColumn("ra", a.agg(pairs("a")).scalar()).withColumn("rb", b.agg(pairs("b")).scalar())
    expected = F.col("ra") * F.col("rb") / (F.col("n") * (F.col("n") - 1) / 2)
    return x.select(((F.col("both") - expected) / ((F.col("ra") + F.col("rb")) / 2 - expected + shift)).alias("ari"))


def mutual_information(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mutual information over the mean of the two entropies, within [-1, 1]: the expected value is taken as 0."""
    n, a, b = _table(df, truth, predicted)
    total = n.agg(F.sum("n")).scalar()
    cells = n.join(a, "t").join(b, "p").withColumn("total", total)
    mi = F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b"))))
    h = lambda f, c: f.withColumn("total", total).agg(-F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total")))).scalar()
    one = cells.agg(mi.alias("mi")).withColumn("ha", h(a, "a")).withColumn("hb", h(b, "b"))
    mean = (F.col("ha") + F.col("hb")) / 2
    return one.select(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(mean == 0, 1.0).otherwise(F.col("mi") / mean))).alias("ami"))


def accuracy(truth, predicted) -> Column:
    return F.avg((truth == predicted).cast("double"))


def mean_squared_error(truth, predicted) -> Column:
    return F.avg((truth - predicted) * (truth - predicted))


def r2_score(df: DataFrame, truth: str, predicted: str, shift: float = 1e-10) -> DataFrame:
    """1 - residual / (total + shift), in two passes, so that nothing cancels; not the squared correlation."""
    x = df.withColumn("__m", df.agg(F.avg(truth)).scalar())
    t, p = F.col(truth), F.col(predicted)
    return x.agg((1 - F.sum((t - p) * (t - p)) / (F.sum((t - F.col("__m")) * (t - F.col("__m"))) + shift)).alias("r2"))


def error_metrics(df: DataFrame, exact: str, value: str, least: float = 1e-10) -> DataFrame:
    e = F.abs(F.col(exact) - F.col(value))
    return df.agg(F.max(e).alias("max_abs"), F.avg(e).alias("mean_abs"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.when(F.abs(F.col(exact)) > least, e / F.abs(F.col(exact)))).alias("max_rel"))


def roc_auc(df: DataFrame, score: str, label: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Area under the ROC curve by trapezoids. Rows of one score are one step, so ties don't depend on an order.

    Rows are first counted by score; the running sums are then over distinct scores.
    """
    steps = df.groupBy(*by, score).agg(F.sum(F.col(label)).cast("double").alias("tp"), F.sum(1 - F.col(label)).cast("double").alias("fp"))
    w = Window.partitionBy(*by).orderBy(F.desc(score))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    area = F.col("fp") * (F.coalesce(F.sum("tp").over(before), F.lit(0.0)) + F.col("tp") / 2)
    return steps.withColumn("area", area).groupBy(*by).agg((F.sum("area") / F.nullif(F.sum("tp") * F.sum("fp"), F.lit(0.0))).alias("auc"))


def macro_auc(df: DataFrame, scores: str, label: str, classes: int) -> DataFrame:
    """Mean of the one-against-rest areas; scores is an array by class."""
    each = df.select(label, F.posexplode(scores).alias("class", "score")).filter(F.col("class") < classes).withColumn("hit", (F.col(label) == F.col("class")).cast("int"))
    return roc_auc(each, "score", "hit", ["class"]).agg(F.avg("auc").alias("auc"))
