"""Connected components of distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def components(edges: DataFrame, local_rows: int = 200_000) -> DataFrame:
    """(node, root) for edges (a, b): every node that isn't the smallest of its component, with that smallest one.

    Stars alternate: each node ties its larger neighbours to its smallest one, then its smaller neighbours and itself to the smallest of them. Rounds grow
    with the logarithm of the nodes and edges never grow in number; a node of many neighbours is a skewed join, no group. Up to local_rows edges are joined
    in one task instead.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if now.count() <= local_rows:
        return joined_at_once(now)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        up = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(down.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark


def joined_at_once(edges: DataFrame) -> DataFrame:
    """The same for few edges (u, v), whose number was checked."""

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(edges.schema["u"].dataType)
    fields = getattr(edges.schema["u"].dataType, "names", None)
    plain = (lambda x: tuple(x.values())) if fields else (lambda x: x)
    nested = (lambda x: dict(zip(fields, x))) if fields else (lambda x: x)

    def mapped(batches):
        import pyarrow as pa

        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for b in batches:
            for u, v in zip(*(map(plain, b[c].to_pylist()) for c in ("u", "v"))):
                u, v = root(u), root(v)
                parent[max(u, v)] = min(u, v)
        out = [(nested(x), nested(root(x))) for x in list(parent) if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], kind) for k in (0, 1)], names=["node", "root"])

    name = dict(edges.dtypes)["u"]
    return edges.coalesce(1).mapInArrow(mapped, f"node {name}, root {name}")
