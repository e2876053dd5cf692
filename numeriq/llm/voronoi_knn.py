"""Exact top-k by inner product as a Voronoi kNN join.

Vectors become integers, floor(scale * x). The order by inner product q.s = |q| |s| cos(q, s) depends on the angle to the query and on the
norm of s, so cells are those of directions, and bounds are those of angles and norms.

1. Pivots are directions of data vectors, chosen by the hash of their id, about the square root of the number of rows. Each vector goes to
   the cell of its nearest pivot; queries too, and a cell with many queries is cut into groups of bounded size.
2. Data are sorted by cell, ring of norms and angle to the pivot, and cut into blocks of bounded size; a cell with a third of all rows is just
   many blocks. Summaries: size, largest angle and range of norms of each block, the rows nearest to each pivot, the largest angle of a group's
   queries to their pivot.
3. For a group, by the triangle inequality of angles, summaries give a score (per unit of |q|) that k other rows reach for each of its
   queries. A block whose bound is lower isn't needed. What is shipped is a block and the groups that need it, the queries being the
   replicated side; a block that many queries need is sent once for each `query_rows` or so of them.
4. Each block is solved locally with the queries sent to it, and the partial results are merged.

Directions without structure can't be told apart by bounds (in 64 independent dimensions all angles are near 90 degrees); then all blocks are
needed, and this is a join of bounded blocks.

Vectors that are null, empty or hold null or non-finite components take no part. Shorter vectors count as padded with zeros. Equal
scores go to the smaller vec_id; rows of the query's own vec_id are no candidates; of repeated query rows the smallest vector counts;
repeated data rows are candidates each. Empty tables give no rows; other columns are ignored. Scores are exact as long as they fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean_numpy, materialize, table

#: Slack of angles, and of bounds relative to the norms, for rounding.
SLACK = 1e-6


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    v = F.col(vector_col)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return vectors.filter(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def matrix(column, dim: int):
    import numpy as np

    out = np.zeros((len(column), dim), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def products(q, d):
    """Exact integer inner products; by floating point where it can hold them."""
    import numpy as np

    most = int(np.abs(q).max(initial=0)) * int(np.abs(d).max(initial=0)) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(np.float64) @ d.T.astype(np.float64)).astype(np.int64)
    return q @ d.T


def score_bound(angle, low, high, largest: bool):
    """The largest (or least) |s| cos(angle) for norms from low to high; angle is the least (or largest) one possible."""
    import numpy as np

    c = np.cos(angle)
    return np.where((c >= 0) == largest, high * c, low * c)


def routed_blocks(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, pivots: int | None = None, block_rows: int = 4096, query_rows: int = 8192):
    """(blocks, queries, routes, dimension), or None where nothing can be found. blocks: vec_id, v, block; queries: vec_id, v, cell, part_of;
    routes: block, cell, part_of, part. pivots: how many; None for the square root of the number of rows, 4096 at most."""
    import numpy as np

    rows = integers(vectors, id_col, vector_col, scale)
    stats = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.count_if(is_query).alias("queries")).first()
    if not stats["n"] or not stats["queries"]:
        return None
    dim = stats["dim"]
    wanted = pivots or min(4096, max(8, int(stats["n"] ** 0.5)))
    chosen = matrix([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(wanted).collect()], dim).astype(np.float64)
    size = np.linalg.norm(chosen, axis=1)
    centre = chosen[size > 0] / size[size > 0, None] if (size > 0).any() else np.eye(1, dim)
    between = np.arccos(np.clip(centre @ centre.T, -1, 1))

    def assigned(batches: Iterator) -> Iterator:
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                x = matrix(part["v"], dim).astype(np.float64)
                norm = np.linalg.norm(x, axis=1)
                cos = np.clip(x @ centre.T / np.maximum(norm, 1e-300)[:, None], -1, 1)
                cell = cos.argmax(1)
                angle = np.arccos(cos[np.arange(len(x)), cell])
                ring = np.floor(2 * np.log2(np.maximum(norm, 0.5)))
                yield part.assign(cell=cell.astype("int32"), angle=angle, norm=norm, ring=ring.astype("int32"))

    shape = "vec_id long, v array<long>, cell int, angle double, norm double, ring int"
    data = rows.mapInPandas(assigned, shape)
    own = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("copies"))
    # A query of norm 0 scores 0 with all rows, so its cell is one that needs every block.
    queries = own.select("vec_id", "v").mapInPandas(assigned, shape).withColumn("cell", F.when(F.col("norm") == 0, len(centre)).otherwise(F.col("cell")))
    most = own.agg(F.max("copies")).first()[0]
    # One row for each cell: how many queries it has; a cell of many is dealt to groups by hash.
    cells = {r["cell"]: (r["n"], r["reach"]) for r in queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("reach")).collect()}
    cut_in = {c: max(1, -(-n // query_rows)) for c, (n, _) in cells.items()}
    parts_of = F.create_map(*[F.lit(x) for kv in cut_in.items() for x in kv])
    queries = materialize(queries.withColumn("part_of", F.pmod(F.xxhash64("vec_id"), parts_of[F.col("cell")].cast("long")).cast("int")).select("vec_id", "v", "cell", "part_of"), "knn-queries")

    def cut(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for pdf in batches:
            place = pdf.groupby("cell").cumcount() + pdf["cell"].map(seen).fillna(0).astype("int64")
            for c, n in pdf["cell"].value_counts().items():
                seen[c] = seen.get(c, 0) + n
            yield pdf.drop(columns="ring").assign(block=pd.Series([f"{part}-{c}-{p // block_rows}" for c, p in zip(pdf["cell"], place)], index=pdf.index, dtype="object"))

    dealt = max(1, -(-stats["n"] // (2 * block_rows)))
    order = ["cell", "ring", "angle", "vec_id"]
    blocks = materialize(data.repartitionByRange(dealt, *order).sortWithinPartitions(*order).mapInPandas(cut, shape.replace(", ring int", ", block string")), "knn-blocks")

    summary = blocks.groupBy("block", "cell").agg(F.max("angle").alias("far"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.count("*").alias("n"))
    need, listed = k + most, min(k + most, k + 64)
    nearest = blocks.withColumn("r", F.row_number().over(Window.partitionBy("cell", "block").orderBy("angle"))).filter(F.col("r") <= listed)
    nearest = nearest.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("angle"))).filter(F.col("r") <= listed)
    # At most pivots * listed rows.
    near = np.array([(r["cell"], r["angle"], r["norm"]) for r in nearest.select("cell", "angle", "norm").collect()])
    groups = sorted((c, g) for c, n in cut_in.items() for g in range(n))
    reached = {}
    for c, (_, reach) in cells.items():
        reached[c] = -np.inf
        if c < len(centre) and len(near) >= need:
            least = score_bound(np.minimum(np.pi, between[c, near[:, 0].astype(int)] + reach + near[:, 1] + SLACK), near[:, 2], near[:, 2], False)
            reached[c] = np.partition(least, len(least) - need)[len(least) - need]
    of = np.array([c for c, _ in groups])
    known = of < len(centre)
    reach = np.array([cells[c][1] for c in of])
    within = np.array([reached[c] for c in of])
    holds = np.array([-(-cells[c][0] // cut_in[c]) for c in of])
    to = between[np.where(known, of, 0)]

    def needed(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for block, j, far, low, high in zip(pdf["block"], pdf["cell"], pdf["far"], pdf["low"], pdf["high"]):
                best = score_bound(np.maximum(0.0, to[:, j] - reach - far - SLACK), low, high, True)
                on = np.flatnonzero(~known | (best + SLACK * high >= within))
                part = (np.cumsum(holds[on]) - holds[on]) // query_rows
                out += [(block, *groups[g], int(p)) for g, p in zip(on, part)]
            yield pd.DataFrame(out, columns=["block", "cell", "part_of", "part"])

    routes = materialize(summary.mapInPandas(needed, "block string, cell int, part_of int, part int"), "knn-routes")
    return blocks.select("vec_id", "v", "block"), queries, routes, dim


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, **options) -> DataFrame:
    """query_id, rank, vec_id, score. is_query is a condition on vec_id; options are those of routed_blocks."""
    import numpy as np

    found = routed_blocks(vectors, is_query, k, **options)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, queries, routes, dim = found
    sent = routes.join(queries.select("cell", "part_of", F.col("vec_id").alias("query_id"), F.col("v").alias("q")), ["cell", "part_of"]).select("block", "part", "query_id", "q")
    held = blocks.join(routes.select("block", F.col("part").alias("deal")).distinct(), "block")

    def solved(left, right):
        import pandas as pd

        lean_numpy()
        out = []
        if len(left) and len(right):
            left = left.sort_values("vec_id", kind="stable")
            ids, d = left["vec_id"].to_numpy(), matrix(left["v"], dim)
            for at in range(0, len(right), 256):
                some = right.iloc[at : at + 256]
                scores = products(matrix(some["q"], dim), d)
                for query, s in zip(some["query_id"].to_numpy(), scores):
                    own = ids == query
                    n = len(s) - int(own.sum())
                    if n <= 0:
                        continue
                    if own.any():
                        s = np.where(own, np.iinfo(np.int64).min, s)
                    least = np.partition(s, len(s) - k)[len(s) - k] if n > k else np.iinfo(np.int64).min + 1
                    place = np.flatnonzero(s >= least)
                    place = place[np.argsort(-s[place], kind="stable")][:k]
                    out += [(query, ids[p], s[p]) for p in place]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    partial = held.groupBy("block", "deal").cogroup(sent.groupBy("block", "part")).applyInPandas(solved, "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
