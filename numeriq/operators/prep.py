"""Preprocessing. Statistics are one-row scalar subqueries: one pass with partial aggregates, nothing is collected or cross-joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stats(df: DataFrame, **aggregates: Column) -> Column:
    return df.agg(*[a.alias(n) for n, a in aggregates.items()]).select(F.struct("*")).scalar()


def standard_scale(df: DataFrame, columns: list[str], floor: float = 1e-9) -> DataFrame:
    """(x - mean) / population deviation, which is at least `floor`."""
    s = _stats(df, **{f"m_{c}": F.avg(c) for c in columns}, **{f"s_{c}": F.stddev_pop(c) for c in columns})
    return df.withColumn("__s", s).withColumns({c: (F.col(c) - F.col(f"__s.m_{c}")) / F.greatest(F.col(f"__s.s_{c}"), F.lit(floor)) for c in columns}).drop("__s")


def sample_scale(df: DataFrame, columns: list[str], least: float = 1e-10) -> DataFrame:
    """With the sample deviation; one below `least` counts as 1."""
    s = _stats(df, **{f"m_{c}": F.avg(c) for c in columns}, **{f"s_{c}": F.stddev_samp(c) for c in columns})
    d = {c: F.col(f"__s.s_{c}") for c in columns}
    return df.withColumn("__s", s).withColumns({c: (F.col(c) - F.col(f"__s.m_{c}")) / F.when(d[c] < least, 1.0).otherwise(d[c]) for c in columns}).drop("__s")


def sparse_scale(df: DataFrame, columns: list[str], floor: float = 1e-9) -> DataFrame:
    """Scaled by the mean and deviation of the non-zero values; zeros stay zero."""
    some = {c: F.when(F.col(c) != 0, F.col(c)) for c in columns}
    s = _stats(df, **{f"m_{c}": F.avg(some[c]) for c in columns}, **{f"s_{c}": F.stddev_pop(some[c]) for c in columns})
    return df.withColumn("__s", s).withColumns({c: F.when(F.col(c) != 0, (F.col(c) - F.col(f"__s.m_{c}")) / F.greatest(F.col(f"__s.s_{c}"), F.lit(floor))).otherwise(0.0) for c in columns}).drop("__s")


def center(df: DataFrame, columns: list[str]) -> DataFrame:
    s = _stats(df, **{f"m_{c}": F.avg(c) for c in columns})
    return df.withColumn("__s", s).withColumns({c: F.col(c) - F.col(f"__s.m_{c}") for c in columns}).drop("__s")


def missing_aware_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, deviation): sums over present values, divided by the number of all rows."""
    n = F.count("*").cast("double")
    one = df.agg(*[F.struct(F.lit(c).alias("feature"), (F.sum(c) / n).alias("mean"), F.sqrt(F.sum(F.col(c) * F.col(c)) / n - F.pow(F.sum(c) / n, 2.0)).alias("deviation")).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.col(c) for c in columns])))


def fill_missing(df: DataFrame, columns: list[str], how: str = "mean") -> DataFrame:
    """Nulls become 0, the column's mean, or NaN."""
    if how == "mean":
        s = _stats(df, **{f"m_{c}": F.avg(c) for c in columns})
        return df.withColumn("__s", s).withColumns({c: F.coalesce(F.col(c), F.col(f"__s.m_{c}")) for c in columns}).drop("__s")
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0 if how == "zero" else float("nan"))) for c in columns})


def log_transform(df: DataFrame, columns: list[str], shift: float = 1e-10) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) > 0, F.log(F.col(c) + shift)).otherwise(F.col(c)) for c in columns})


def drop_outliers(df: DataFrame, columns: list[str], limit: float = 3.0, floor: float = 1e-9) -> DataFrame:
    """Rows with no |z| above the limit."""
    s = _stats(df, **{f"m_{c}": F.avg(c) for c in columns}, **{f"s_{c}": F.stddev_pop(c) for c in columns})
    z = [F.abs(F.col(c) - F.col(f"__s.m_{c}")) / F.greatest(F.col(f"__s.s_{c}"), F.lit(floor)) for c in columns]
    return df.withColumn("__s", s).filter(F.greatest(F.lit(0.0), *z) <= limit).drop("__s")


def ordered_split(df: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """train: whether a row is among the first share by key. The cut is one exact quantile; no row is numbered."""
    cut = df.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {key})").alias("c")).scalar()
    return df.withColumn("train", F.col(key) <= cut)


def hash_split(df: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """train by a linear congruential hash of the key: random to look at, the same in every run."""
    return df.withColumn("train", (F.pmod(F.pmod(F.col(key).cast("long"), F.lit(1 << 31)) * 1103515245 + 12345, F.lit(1 << 31)) / float(1 << 31)) < share)


def hash_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A reproducible random order: rows are ranged by a seeded hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def to_coordinates(df: DataFrame, row: str, vector: str) -> DataFrame:
    """(i, j, v) of vectors; i is the row's key, j counts from 0."""
    return df.select(F.col(row).alias("i"), F.posexplode(vector).alias("j", "v")).withColumn("v", F.col("v").cast("double"))


def drop_zeros(coordinates: DataFrame) -> DataFrame:
    return coordinates.filter("v <> 0")


def to_dense(coordinates: DataFrame, columns: int) -> DataFrame:
    """A row per i with columns c0, c1, ...; missing ones are 0."""
    return coordinates.groupBy("i").agg(*[F.sum(F.when(F.col("j") == j, F.col("v")).otherwise(0.0)).alias(f"c{j}") for j in range(columns)])
