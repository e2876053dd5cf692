"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine only where none is set (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: For tables whose rows are megabytes: a task that reads or writes them holds a row group, which Parquet lets grow for a hundred rows before it looks at its size.
LONG_ROWS = {"parquet.block.row.count.limit": 1}


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Cuts the lineage: df written as a table in the shared folder, and read again. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of text that travel to a Python worker at once.
BATCH_ROWS = 2000
#: And bytes.
BATCH_BYTES = 32 << 20


def lean(df: DataFrame) -> DataFrame:
    """df, after bounding what a Python worker holds at once: whole texts are long, and Spark's defaults are 10,000 rows a batch and no bound of bytes.

    Results are lazy, so these settings stay with the session; smaller ones of the caller are kept.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = "spark.sql.execution.arrow." + name
        now = int(df.sparkSession.conf.get(name).removesuffix("b"))
        if not 0 < now <= most:
            df.sparkSession.conf.set(name, str(most))
    return df


def lean_numpy(kept_mb: int = 256) -> None:
    """Called in tasks of many small array operations: a task has one core, so BLAS gets one thread, and freed arrays stay with the process
    instead of going back to the system and being faulted in again. Does nothing where the libraries aren't the usual ones."""
    import ctypes
    import glob
    import os

    import numpy as np

    for path in glob.glob(os.path.join(os.path.dirname(np.__file__) + ".libs", "*openblas*")):
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if f := getattr(ctypes.CDLL(path), name, None):
                f(1)
                break
    if mallopt := getattr(ctypes.CDLL(None), "mallopt", None):
        mmap_threshold, trim_threshold = -3, -1
        mallopt(mmap_threshold, 32 << 20)
        mallopt(trim_threshold, kept_mb << 20)


def give_back() -> None:
    """Called at the end of a task that held much: workers live on, and freed memory goes back to the system for those that come after."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as text, since pandas would make floating-point numbers of a column of integers and nulls; and text."""
    return lean(docs).select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))


def id_back(df: DataFrame, name: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("long"))


def raw_digest() -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.col("text").cast("string"))


def unused(df: DataFrame, name: str) -> str:
    """The name, longer by underscores if df has a column of that name (in any case)."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of docs that aren't in gone (doc_id, raw); the columns of docs. gone is broadcast up to that many rows (16 bytes each)."""
    id_, raw = (unused(docs, name) for name in ("__id", "__raw"))
    ids = materialize(gone.select(F.col("doc_id").alias(id_), F.col("raw").alias(raw)).distinct(), "gone")
    ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (raw_digest() == F.col(raw))
    return docs.join(ids, same, "left_anti")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def runs(batches: Iterator, keys: list[str]) -> Iterator:
    """Whole groups from batches that are sorted by keys; a group may span batches."""
    import pandas as pd

    held: list = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys]
        new = (k != k.shift()).any(axis=1).to_numpy()
        new[0] = True
        starts = [i for i, x in enumerate(new) if x] + [len(pdf)]
        for a, b in zip(starts, starts[1:]):
            part = pdf.iloc[a:b]
            key = tuple(part[keys].iloc[0])
            if held and key != last:
                yield last, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            last = key
            held.append(part)
    if held:
        yield last, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def shared_model(spark: SparkSession, model):
    """A broadcast of a fitted model, whose size its own parameters bound; opened() reads it, in tasks and here."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def opened(held):
    return cloudpickle.loads(held.value)
