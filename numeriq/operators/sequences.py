"""Ordered computations: running sums, differences, split points, grids of half the size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: list[str], value: str, ranges: int = 64) -> DataFrame:
    """total: the sum of value up to each row in order, over all rows, without a task that sees all of them.

    Rows are dealt to ranges at quantiles of the first ordering column (at most `ranges` numbers come to the driver); sums of ranges
    are summed first, and each range then goes on from its own start.
    """
    cuts = sorted(set(df.agg(F.percentile_approx(order[0], [i / ranges for i in range(1, ranges)], 10_000).alias("c")).first()["c"] or []))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order[0]))) if cuts else F.lit(0)
    dealt = df.withColumn("__part", part)
    starts = dealt.groupBy("__part").agg(F.sum(value).alias("__sum")).withColumn("__start", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(starts.select("__part", "__start")), "__part").withColumn("total", F.col("__start") + F.sum(value).over(w)).drop("__part", "__start")


def differences(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """step: the next value less this one."""
    return df.withColumn("step", F.lead(value).over(Window.partitionBy(*by).orderBy(*order)) - F.col(value))


def cumulative_share(df: DataFrame, by: list[str], order: list[str], weight: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn("cdf", F.sum(weight).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(w))


def first_reaching(df: DataFrame, by: list[str], order: list[str], cdf: str, levels: list[float]) -> DataFrame:
    """The rows at which a running share first reaches a level, with the level as u: those whose share is at or above it while that of the row before is below. A
    row is copied only for levels that it reaches."""
    before = F.coalesce(F.lag(cdf).over(Window.partitionBy(*by).orderBy(*order)), F.lit(float("-inf")))
    reached = F.filter(F.array(*map(F.lit, levels)), lambda u: (F.col(cdf) >= u) & (F.col("__before") < u))
    return df.withColumn("__before", before).withColumn("u", F.explode(reached)).drop("__before")


def split_scan(df: DataFrame, features: list[str], label: str, impurity: str = "entropy", node: list[str] = [], weight: str | None = None) -> DataFrame:  # noqa: B006
    """feature, threshold, gain of every midpoint between neighbouring values.

    Rows are counted by (feature, value, label) first, so windows run over distinct values. impurity: entropy, gini or variance;
    a column of weights counts for variance only.
    """
    if impurity == "variance":
        df = df.withColumn("__w", F.col(weight).cast("double") if weight else F.lit(1.0))
        node = [*node, "__w"]
    long = df.select(*node, label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select(*node, label, "x.*")
    by = [*[n for n in node if n != "__w"], "feature"]
    order = Window.partitionBy(*by).orderBy("value")
    if impurity == "variance":
        sums = long.groupBy(*by, "value").agg(F.sum("__w").alias("n"), F.sum(F.col("__w") * F.col(label)).alias("s"), F.sum(F.col("__w") * F.col(label) * F.col(label)).alias("q"))
        up, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
        cols = {c + "l": F.sum(c).over(up) for c in "nsq"} | {c + "t": F.sum(c).over(whole) for c in "nsq"} | {"next": F.lead("value").over(order)}
        x = sums.withColumns(cols).filter("next is not null")
        var = lambda n, s, q: q / n - (s / n) * (s / n)
        nl, sl, ql, nt, st, qt = (F.col(c) for c in ("nl", "sl", "ql", "nt", "st", "qt"))
        gain = var(nt, st, qt) - nl / nt * var(nl, sl, ql) - (nt - nl) / nt * var(nt - nl, st - sl, qt - ql)
        return x.select(*by, ((F.col("value") + F.col("next")) / 2).alias("threshold"), gain.alias("gain"))
    counts = long.groupBy(*by, "value", label).agg(F.count("*").alias("n"))
    # Every distinct value has a row for each label, so that running counts by label meet at each value.
    labels = long.groupBy(*by).agg(F.collect_set(label).alias("labels"))
    values = counts.groupBy(*by, "value").agg(F.map_from_entries(F.collect_list(F.struct(F.col(label), "n"))).alias("at")).join(labels, by)
    full = values.select(*by, "value", "at", F.explode("labels").alias("label")).withColumn("n", F.coalesce(F.try_element_at("at", F.col("label")), F.lit(0)).cast("double")).drop("at")
    per = Window.partitionBy(*by, "label")
    x = full.withColumn("left", F.sum("n").over(per.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(per))

    def measure(c):
        n = F.sum(c)
        if impurity == "gini":
            return F.when(n > 0, 1 - F.sum(c * c) / (n * n)).otherwise(0.0)
        return F.when(n > 0, F.log2(n) - F.sum(F.when(c > 0, c * F.log2(c)).otherwise(0.0)) / n).otherwise(0.0)

    left, whole = F.col("left"), F.col("all")
    scored = x.groupBy(*by, "value").agg(F.sum(left).alias("nl"), F.sum(whole).alias("nt"), measure(left).alias("il"), measure(whole).alias("it"), measure(whole - left).alias("ir"))
    gain = F.col("it") - F.col("nl") / F.col("nt") * F.col("il") - (F.col("nt") - F.col("nl")) / F.col("nt") * F.col("ir")
    return scored.withColumn("next", F.lead("value").over(order)).filter("next is not null").select(*by, ((F.col("value") + F.col("next")) / 2).alias("threshold"), gain.alias("gain"))


def best_split(scan: DataFrame, node: list[str] = []) -> DataFrame:  # noqa: B006
    """The largest gain, ties (within 1e-12) to the first feature by name and then the smallest threshold."""
    first = F.min_by(F.struct("feature", "threshold", "gain"), F.struct((-F.round("gain", 12)).alias("g"), "feature", "threshold"))
    return scan.groupBy(*node).agg(first.alias("b")).select(*node, "b.*")


def restrict(grid: DataFrame, r: str = "r", c: str = "c", v: str = "v") -> DataFrame:
    """A grid of half the size: each cell is a quarter of the sum of its 2 x 2 cells, missing ones counting as 0."""
    return grid.groupBy(F.floor(F.col(r) / 2).alias(r), F.floor(F.col(c) / 2).alias(c)).agg((F.sum(v) / 4).alias(v))


def prolong(grid: DataFrame, r: str = "r", c: str = "c", v: str = "v") -> DataFrame:
    """A grid of double the size, bilinear: each cell adds to the 3 x 3 cells around its double, by 1, 1/2 and 1/4."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(1.0 / (1 + abs(a)) / (1 + abs(b))).alias("k")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("m")
    sent = grid.select(r, c, v, moves).select((F.col(r) * 2 + F.col("m.a")).alias(r), (F.col(c) * 2 + F.col("m.b")).alias(c), (F.col(v) * F.col("m.k")).alias(v))
    return sent.filter((F.col(r) >= 0) & (F.col(c) >= 0)).groupBy(r, c).agg(F.sum(v).alias(v))


def contiguous_parts(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """part: n runs of nearly equal length in order; the k-th begins at floor(k * rows / n)."""
    w = Window.partitionBy(*by)
    place, rows = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    return df.withColumn("part", F.floor(((place + 1) * n - 1) / rows).cast("int"))
