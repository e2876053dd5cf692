"""Structured Streaming: event-time windows with state and a watermark, medians of a stream, and particle filters."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import medians
from ..plans.lineage import cut, shared_dir


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_end(stream: DataFrame, per_batch) -> None:
    """Runs per_batch(df, id) over all that is there, each batch once even if the query is restarted."""
    spark = stream.sparkSession
    q = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", shared_path(spark, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()


def arrivals(rows: DataFrame, part: Column, path: str | None = None) -> str:
    """The folder of a stream made of a table: rows by part, a file set for each, written one after another, since a file stream goes by time of writing."""
    path = path or shared_path(rows.sparkSession, "arrivals")
    dealt = cut(rows.withColumn("__part", part))
    for (p,) in dealt.select("__part").distinct().orderBy("__part").collect():
        dealt.filter(F.col("__part").eqNullSafe(F.lit(p))).drop("__part").coalesce(1).write.mode("append").parquet(path)
    return path


def windowed_counts(events: DataFrame, time: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "1 hour", gap: str | None = None) -> DataFrame:
    """n and total by event-time window (a session if a gap is given) and keys; for a stream, windows close when the watermark passes them."""
    w = F.session_window(time, gap) if gap else F.window(time, width, slide) if slide else F.window(time, width)
    grouped = events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def stream_windowed_counts(spark: SparkSession, path: str, schema: T.StructType, time: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "1 hour", gap: str | None = None, still_open: bool = True) -> DataFrame:
    """start, end, keys, n, total, closed: the windows of a stream, run over all that is there.

    Sums are kept in the state store from batch to batch. When the watermark (the latest time of earlier batches less `late`) passes a window's end, the
    window is appended to the result, once, and its state is dropped; rows that come for it afterwards are dropped. What is still open is read from the
    state at the end (not for sessions).
    """
    out, progress = shared_path(spark, "windows"), shared_path(spark, "progress")
    windows = windowed_counts(stream_of(spark, path, schema), time, keys, value, width, slide, late, gap)
    q = windows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
    q.awaitTermination()
    closed = spark.read.schema(windows.schema).parquet(out).withColumn("closed", F.lit(True))
    if gap or not still_open:
        return closed
    state = spark.read.format("statestore").load(progress)
    window = state.schema["key"].dataType.names[0]
    n, total = state.schema["value"].dataType.names[-2:]
    held = state.select(F.col(f"key.{window}.start").alias("start"), F.col(f"key.{window}.end").alias("end"), *[F.col(f"key.{k}").alias(k) for k in keys], F.col(f"value.{n}").alias("n"), F.col(f"value.{total}").alias("total"))
    return closed.unionByName(held.withColumn("closed", F.lit(False)))


def stream_clusters(spark: SparkSession, path: str, schema: T.StructType, vector: str, least: int, most: int, seed: int = 1) -> DataFrame:
    """(id, weight, v) of between least and most weighted medians of a stream.

    Each micro-batch is searched for its own medians, which a table keeps as the weighted means of their members; ids go on from batch to batch: a row's place in its
    batch (by file and row) after all rows of the batches before. When the stream ends, the kept centres are searched as weighted points. A batch that
    is run again after a failure writes the same rows in the same place.
    """
    out = shared_path(spark, "medians")
    kept = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("weight", T.DoubleType())])

    def seen_before(batch: int) -> int:
        if not batch:
            return 0
        table = spark.read.schema("rows long, batch long").parquet(f"{out}/counts")
        return table.filter(F.col("batch") < batch).agg(F.sum("rows")).first()[0] or 0

    def per_batch(df: DataFrame, batch: int) -> None:
        here = cut(df)
        files = here.groupBy("__file").agg(F.count("*").alias("n")).orderBy("__file").collect()
        starts, total = [], seen_before(batch)
        begun = total
        for file, n in files:
            starts.append((file, total))
            total += n
        numbered = here.join(F.broadcast(spark.createDataFrame(starts, "__file string, __start long")), "__file")
        rows = numbered.select((F.col("__start") + F.col("__row")).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.lit(1.0).alias("weight"))
        points = medians.weighted_points(rows, seed)
        found = medians.drawn_to_members(points, medians.k_median(points, least, most)) if points.count else []
        centres = [(int(i), [float(x) for x in v], w) for i, v, w in found]
        spark.createDataFrame(centres, kept).write.mode("overwrite").parquet(f"{out}/centres/batch={batch}")
        spark.createDataFrame([(total - begun,)], "rows long").write.mode("overwrite").parquet(f"{out}/counts/batch={batch}")

    stream = stream_of(spark, path, schema).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    run_to_end(stream, per_batch)
    every = spark.read.schema(kept).parquet(f"{out}/centres").select("id", "v", "weight")
    points = medians.weighted_points(every, seed)
    found = medians.drawn_to_members(points, medians.k_median(points, least, most)) if points.count else []
    return spark.createDataFrame([(int(i), w, [float(x) for x in v]) for i, v, w in found], "id long, weight double, v array<double>")


def filter_step(x: Any, v: float, frame: int, seed: list[int], noise: float) -> tuple[Any, float]:
    """(particles, estimate) after a frame: moved by noise that seed and frame fix, weighted by a Gaussian likelihood, resampled from the running sums of weights."""
    import numpy as np

    rng = np.random.default_rng([*seed, frame])
    x = x + noise * rng.standard_normal(len(x))
    w = np.exp(-0.5 * ((x - v) / noise) ** 2) + 1e-300
    w /= w.sum()
    u = (np.arange(len(x)) + rng.random()) / len(x)
    return x[np.minimum(np.searchsorted(np.cumsum(w), u), len(x) - 1)], float((w * x).sum())


def particle_filter(observations: DataFrame, by: str, order: str, value: str, particles: int = 128, noise: float = 1.0, seed: int = 7) -> DataFrame:
    """(by, order, estimate): a bootstrap filter of a random walk for each series, frame after frame, in the series' own task.

    Batches of a sorted partition stream through, so a series of any length needs the memory of its particles only.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        key, x, frame = None, None, 0
        for pdf in batches:
            out = []
            for k, o, v in zip(pdf[by], pdf[order], pdf[value]):
                if x is None or k != key:
                    key, x, frame = k, np.full(particles, float(v)), 0
                x, estimate = filter_step(x, v, frame, [seed, zlib.crc32(str(k).encode())], noise)
                out.append((k, o, estimate))
                frame += 1
            yield pd.DataFrame(out, columns=[by, order, "estimate"])

    types = dict(observations.dtypes)
    rows = observations.select(by, order, F.col(value).cast("double").alias(value)).filter(F.col(by).isNotNull() & F.col(value).isNotNull())
    dealt = rows.repartition(by).sortWithinPartitions(by, order)
    return dealt.mapInPandas(run, f"{by} {types[by]}, {order} {types[order]}, estimate double")


def stream_particle_filter(spark: SparkSession, path: str, schema: T.StructType, by: str, order: str, value: str, particles: int = 128, noise: float = 1.0, seed: int = 7) -> DataFrame:
    """The same for a stream: a series' particles and frame stay in the state store between batches. Rows of a series come in order from batch to batch;
    within a batch they are sorted. Keys and orders are whole numbers."""
    from pyspark.sql.streaming import StatefulProcessor

    class Filter(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("particles", "x array<double>, frame long")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            import numpy as np
            import pandas as pd

            pdf = pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")
            held = self.state.get()
            x, frame = (np.array(held[0]), held[1]) if held else (np.full(particles, float(pdf[value].iloc[0])), 0)
            out = []
            for o, v in zip(pdf[order], pdf[value]):
                x, estimate = filter_step(x, v, frame, [seed, zlib.crc32(str(int(key[0])).encode())], noise)
                out.append((key[0], o, estimate))
                frame += 1
            self.state.update((x.tolist(), frame))
            yield pd.DataFrame(out, columns=[by, order, "estimate"])

        def close(self) -> None:
            pass

    types = {f.name: f.dataType.simpleString() for f in schema}
    rows = stream_of(spark, path, schema).select(by, order, F.col(value).cast("double").alias(value)).filter(F.col(by).isNotNull() & F.col(value).isNotNull())
    out, progress = shared_path(spark, "filtered"), shared_path(spark, "progress")
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        made = rows.groupBy(by).transformWithStateInPandas(Filter(), f"{by} {types[by]}, {order} {types[order]}, estimate double", "Append", "None")
        q = made.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(made.schema).parquet(out)
