"""Readers and writers of the plain formats that numerical programs exchange. Schemas are given or derived from the header; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].split(",") if first else []


def read_points(spark: SparkSession, path: str, index: bool = True, label: bool = True, missing: str | None = None, strict: bool = False) -> DataFrame:
    """id, v, label of a CSV file with a header: an index column first (unless index is false), features, the label last.

    missing: None (as they are), "zero", "mean" or "nan" for the literal NA. strict: malformed rows are an error, and a label that is no
    number is -1.
    """
    names = _header(spark, path)
    unique = [f"c{i}" for i in range(len(names))]
    last = unique[-1] if label else None
    kinds = T.StructType([T.StructField(n, T.StringType() if n == last else T.DoubleType()) for n in unique])
    df = spark.read.csv(path, header=True, schema=kinds, nullValue="NA", mode="FAILFAST" if strict else "PERMISSIVE", enforceSchema=True)
    features = unique[1 if index else 0 : -1 if label else None]
    if missing:
        from ..operators.prep import fill_missing

        df = fill_missing(df, features, missing)
    number = F.expr(f"try_cast({last} AS double)") if label else None
    out = [(F.col(unique[0]).cast("long") if index else F.monotonically_increasing_id()).alias("id"), F.array(*features).alias("v")]
    return df.select(*out, *([F.coalesce(number, F.lit(-1.0)).alias("label") if strict else number.alias("label")] if label else []))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value) of a text file: lines by number from 0, without gaps. They are numbered by counts of partitions, not in one task."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    counts = {r["p"]: r["n"] for r in lines.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p], total = total, total + counts[p]
    offset = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else F.lit(None)
    n = offset[part] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) if starts else F.lit(0)
    return lines.select(n.cast("long").alias("n"), "value")


def read_matrix(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(i, j, v) of a dense CSV matrix; i is the number of the line, from 0."""
    lines = numbered_lines(spark, path)
    rows = lines.filter(F.col("n") >= int(header)).select((F.col("n") - int(header)).alias("i"), F.split("value", ",").alias("x"))
    return rows.select("i", F.posexplode("x").alias("j", "v")).withColumn("v", F.expr("try_cast(trim(v) AS double)"))


def read_matrix_market(spark: SparkSession, path: str, symmetric: bool | None = None) -> DataFrame:
    """(i, j, v), from 0. The entries of a file whose header says symmetric (or with symmetric=True) are mirrored."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    if symmetric is None:
        symmetric = " symmetric" in ((lines.filter("value LIKE '%MatrixMarket%'").limit(1).collect() or [[""]])[0][0])
    body = lines.filter("NOT startswith(value, '%') AND trim(value) <> ''").select("at", F.split(F.trim("value"), r"\s+").alias("p"))
    # The first line that is no comment holds the sizes; an entry may look like it.
    first = body.agg(F.min("at")).first()[0]
    entries = body.filter(F.col("at") != first) if first is not None else body
    a = entries.select((F.col("p")[0].cast("long") - 1).alias("i"), (F.col("p")[1].cast("long") - 1).alias("j"), F.coalesce(F.get("p", F.lit(2)).cast("double"), F.lit(1.0)).alias("v"))
    from ..operators.joins import mirror

    return mirror(a) if symmetric else a


def read_grid(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """(r, c, v) of a text file with one value per line, row by row."""
    lines, n = numbered_lines(spark, path), F.col("n")
    return lines.select(F.floor(n / columns).alias("r"), (n % columns).alias("c"), F.trim("value").cast("double").alias("v"))


def read_float_blocks(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(file, block, v) of raw 32-bit floats, dim to a point. Files are decoded in the tasks that read them; what float_block_tails finds is left out."""

    def decode(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                x = np.frombuffer(content[: len(content) // 4 * 4], "<f4")
                x = x[: len(x) // dim * dim].reshape(-1, dim)
                for at in range(0, len(x), 10_000):
                    part = x[at : at + 10_000]
                    yield pd.DataFrame({"file": name, "block": np.arange(at, at + len(part)), "v": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "file string, block long, v array<float>")


def float_block_tails(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(file, points, tail): whole points of each file of raw floats, and the bytes after the last of them. Only lengths are read."""
    size = 4 * dim
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    return files.select("file", F.floor(F.col("length") / size).alias("points"), (F.col("length") % size).alias("tail"))


def synthetic_points(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    return spark.range(n).select("id", F.array(*[F.rand(seed + j) for j in range(dim)]).alias("v"))


def synthetic_dominant(spark: SparkSession, n: int, per_row: int = 5, seed: int = 42) -> DataFrame:
    """A seeded, diagonally dominant sparse matrix."""
    off = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(per_row))).alias("k"))
    off = off.select("i", F.pmod(F.xxhash64(F.lit(seed), "i", "k"), F.lit(n)).alias("j"), (F.pmod(F.xxhash64(F.lit(seed + 1), "i", "k"), F.lit(1000)) / 1000.0 - 0.5).alias("v")).filter("i <> j").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return off.unionByName(spark.range(n).select(F.col("id").alias("i")).join(off.groupBy("i").agg(F.sum(F.abs("v")).alias("s")), "i", "left").select("i", F.col("i").alias("j"), (F.coalesce("s", F.lit(0.0)) + 1).alias("v")))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(digits, settings map<format, array<variable>>) of a JSON list with one object for each number of digits."""
    df = spark.read.text(path, wholetext=True)
    parsed = df.select(F.from_json("value", "array<map<string,array<string>>>").alias("s"))
    return parsed.select(F.posexplode("s").alias("digits", "settings")).withColumn("digits", F.col("digits") + 1)


def read_runtimes(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, schema="digits string, seconds double")
    return df.filter("digits <> 'Average'").withColumn("digits", F.col("digits").cast("int"))


def read_formats(spark: SparkSession, path: str) -> DataFrame:
    """(letter, exp_bits, mant_bits) of a JSON object of pairs, by mantissa bits."""
    df = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<int>>")).alias("letter", "bits"))
    return df.select("letter", F.col("bits")[0].alias("exp_bits"), F.col("bits")[1].alias("mant_bits")).orderBy("mant_bits")


def write_points(df: DataFrame, path: str, vector: str = "v") -> None:
    """CSV with a header: features, then the other columns."""
    dim = df.agg(F.max(F.size(vector))).first()[0] or 0
    df.select(*[F.col(vector)[j].alias(f"feature_{j}") for j in range(dim)], *[c for c in df.columns if c != vector]).write.mode("overwrite").csv(path, header=True)


def write_centroids(centres: DataFrame, path: str, index: str = "centre", vector: str = "v") -> None:
    """CSV with a header: centroid_index, feature_0, feature_1 ..., in order of the index."""
    dim = centres.agg(F.max(F.size(vector))).first()[0] or 0
    rows = centres.orderBy(index).select(F.col(index).alias("centroid_index"), *[F.col(vector)[j].alias(f"feature_{j}") for j in range(dim)])
    rows.write.mode("overwrite").csv(path, header=True)


def write_weighted_centres(centres: DataFrame, path: str) -> None:
    """Text of centres (id, weight, v), in order of ids: for each a line with its id, one with its weight, one with its coordinates and an empty one; six decimals."""
    coordinates = F.array_join(F.transform("v", lambda x: F.format_string("%.6f", x.cast("double"))), " ")
    lines = F.concat(F.format_string("%d\n%.6f\n", F.col("id"), F.col("weight")), coordinates, F.lit(" \n"))
    centres.orderBy("id").select(lines.alias("value")).write.mode("overwrite").text(path)


def read_weighted_centres(spark: SparkSession, path: str) -> DataFrame:
    """(id, weight, v) of such text. A file is split at its empty lines."""
    parts = spark.read.option("lineSep", "\n\n").text(path).filter(F.trim("value") != "")
    lines = F.split(F.trim("value"), r"\s*\n")
    return parts.select(lines[0].cast("long").alias("id"), lines[1].cast("double").alias("weight"), F.transform(F.split(F.trim(lines[2]), " +"), lambda x: x.cast("double")).alias("v"))


def write_matrix(coordinates: DataFrame, path: str, shape: tuple[int, int] | None = None) -> None:
    """CSV without a header, a line per row, in order of rows; elements that aren't stored are 0. shape: None for that of the largest indexes."""
    if shape is None:
        most = coordinates.agg(F.max("i"), F.max("j")).first()
        shape = (-1 if most[0] is None else most[0]) + 1, (-1 if most[1] is None else most[1]) + 1
    stored = coordinates.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("j").cast("long"), F.col("v").cast("double")))).alias("r"))
    rows = coordinates.sparkSession.range(shape[0]).withColumnRenamed("id", "i").join(stored, "i", "left").orderBy("i")
    values = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(shape[1] - 1).cast("long")), lambda j: F.coalesce(F.try_element_at("r", j), F.lit(0.0)).cast("string"))
    rows.select(F.array_join(values, ",")).write.mode("overwrite").text(path)


def write_solution(x: DataFrame, history: list[float], path: str) -> None:
    x.orderBy("i").write.mode("overwrite").csv(path + "/solution", header=True)
    x.sparkSession.createDataFrame(list(enumerate(history, 1)) or [], "iteration int, residual double").write.mode("overwrite").csv(path + "/history", header=True)


def write_settings(settings: DataFrame, path: str) -> None:
    """A JSON list with the map of formats of each number of digits, in order: what read_settings reads. There are as many as digits."""
    one = settings.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("digits", F.map_entries("settings").alias("s")))), lambda x: F.map_from_entries(x["s"]))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def write_runtimes(runtimes: DataFrame, path: str) -> None:
    """Digits and seconds, with their average as the last row."""
    from ..plans.tuner import runtime_summary

    runtime_summary(runtimes).select(F.coalesce(F.col("digits").cast("string"), F.lit("Average")).alias("Digit"), F.col("seconds").alias("Runtime (seconds)")).write.mode("overwrite").csv(path, header=True)
