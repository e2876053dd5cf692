"""Cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine only where none is set (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Tables written by each application, until they are discarded.
_written: dict[str, list[str]] = {}


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, with statistics for the plans that read it, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark) -> int:
    """Deletes the tables that cut has written in this application, and says how many. Results that read them must have been written before."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    context = spark.sparkContext
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
