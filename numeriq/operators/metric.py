"""Joins of vectors by Euclidean distance, in any dimension: all pairs within a radius, nearest neighbours, density clusters.

Data rows are dealt to the cells of pivots (centres of a bounded sample) and, within a cell, to bins by their distance from the pivot, so that a bin's rows
fit a bounded matrix; rows at one distance that are too many for a bin are dealt to parts by a hash. Queries have a radius and go only to bins that may hold
something within it: the triangle inequality bounds their distance from a bin's ring, and the plane between two pivots that from another cell. Each bin
meets its queries in batches, as matrix products; what they find near the radius is computed again from differences.

Pivots and the table of bins are all that comes to the driver: CELLS vectors and CELLS x RINGS counts. On data without structure in many dimensions no
bound can skip much, and this is a join in blocks: a query is copied once per BIN_BYTES of data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .graph import components

#: Bytes of the vectors of a bin, pivots at most, rings of a cell at most, and rows below which a bin isn't shared by tasks.
BIN_BYTES, CELLS, RINGS, LEAST_ROWS = 16 << 20, 512, 256, 512

#: Parts and deals for each core, and rows for each deal at least.
DEALS, DEALT_ROWS = 6, 4096


def matrix(column: Any):
    """Vectors of an Arrow array as rows."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, np.float64).reshape(len(column), -1)


def squares(a, b):
    """Squared distances of the rows of a and of b, good to rounding of the squared norms."""
    import numpy as np

    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


@dataclass
class Cells:
    """Pivots and bins. A bin has its cell, the least and greatest distance of its rows from the pivot, its rows and the parts they are dealt to."""

    pivots: Any
    width: float
    cell: Any
    low: Any
    high: Any
    rows: Any
    parts: Any
    rings: list[tuple[int, int, int, int]]


def pivots_of(points: DataFrame, cells: int) -> Any:
    """(pivots, width of a ring): Lloyd's centres of a sample of 8 rows a cell."""
    import numpy as np

    some = np.array([r[0] for r in points.select("v").orderBy(F.xxhash64("id")).limit(8 * cells).collect()], np.float64)
    centres = some[:cells].copy()
    for _ in range(5):
        near = squares(some, centres).argmin(1)
        for c in np.unique(near):
            centres[c] = some[near == c].mean(0)
    spread = float(np.sqrt(squares(some, centres).min(1)).mean())
    return centres, spread / 32 or 1.0


def indexed(points: DataFrame, bin_rows: int | None = None) -> tuple[DataFrame, Cells]:
    """(data, cells) of points (id, v, further columns); data has bin and part too. Vectors are finite and of one length."""
    import numpy as np

    spark = points.sparkSession
    first = points.select(F.size("v")).first()
    dim = max(1, first[0] if first else 1)
    count = points.count()
    bin_rows = bin_rows or max(1, BIN_BYTES // (8 * dim))
    cells = min(CELLS, -(-count // bin_rows))
    if cells <= 1:
        parts = max(1, min(spark.sparkContext.defaultParallelism, -(-count // LEAST_ROWS)))
        one = Cells(np.zeros((1, dim)), 1.0, np.zeros(1, int), np.zeros(1), np.full(1, np.inf), np.array([count]), np.array([parts]), [])
        return points.withColumns({"bin": F.lit(0), "part": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")}), one
    pivots, width = pivots_of(points, cells)
    held = spark.sparkContext.broadcast(pivots)

    def assigned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                v = matrix(b["v"])
                cell = squares(v, held.value).argmin(1)
                dist = np.sqrt(((v - held.value[cell]) ** 2).sum(1))
                ring = np.minimum(dist / width, RINGS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(ring), pa.array(dist), *b.columns], names=["cell", "ring", "dist", *b.schema.names])

    kinds = ", ".join(f"{n} {t}" for n, t in points.dtypes)
    table = cut(points.mapInArrow(assigned, f"cell int, ring int, dist double, {kinds}"))
    counts = table.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect()
    bins: list[list] = []
    rings = []
    for r in sorted(counts, key=lambda r: (r["cell"], r["ring"])):
        if not bins or bins[-1][0] != r["cell"] or bins[-1][3] + r["n"] > bin_rows:
            bins.append([r["cell"], r["low"], r["high"], 0])
        bins[-1][2] = r["high"]
        bins[-1][3] += r["n"]
        rings.append((r["cell"], r["ring"], len(bins) - 1))
    cell, low, high, rows = (np.array([b[k] for b in bins]) for k in range(4))
    parts = -(-rows // bin_rows)
    placed = spark.createDataFrame([(c, r, b, int(parts[b])) for c, r, b in rings], "cell int, ring int, bin int, parts int")
    data = table.join(F.broadcast(placed), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("cell", "ring", "dist", "parts")
    return data, Cells(pivots, width, cell, low, high, rows, parts, rings)


def reach(q, cells: Cells):
    """Lower bounds of the distances from rows of q to each bin."""
    import numpy as np

    to = np.sqrt(squares(q, cells.pivots))
    at = to[:, cells.cell]
    ring = np.maximum(np.maximum(cells.low[None] - at, at - cells.high[None]), 0)
    own = to.argmin(1)
    apart = np.sqrt(squares(cells.pivots, cells.pivots))[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (to**2 - to.min(1)[:, None] ** 2) / (2 * apart)
    plane = np.where(np.isfinite(plane), np.maximum(plane, 0), 0)[:, cells.cell]
    slack = 1e-6 * (1 + to.max())
    return np.maximum(np.maximum(ring, plane) - slack, 0)


def routed(queries: DataFrame, cells: Cells, first: int | None = None) -> DataFrame:
    """queries (qid, q, radius, further columns) with the bin and part of everything within their radius; with first, of the nearest bins that hold so many rows."""
    names = queries.columns

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        c = cells
        step = max(1, 4_000_000 // len(c.cell))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                bound = reach(matrix(b["q"]), c)
                if first is None:
                    i, j = np.nonzero(bound <= b["radius"].to_numpy()[:, None])
                    n = c.parts[j]
                    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    i, j = np.repeat(i, n), np.repeat(j, n)
                else:
                    order = bound.argsort(1, kind="stable")
                    before = np.cumsum((c.rows // c.parts)[order], 1) - (c.rows // c.parts)[order]
                    i, k = np.nonzero(before < first)
                    j, part = order[i, k], np.zeros(len(i), int)
                for s in range(0, len(i), 4096):
                    t = b.take(pa.array(i[s : s + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(j[s : s + 4096], pa.int32()), pa.array(part[s : s + 4096], pa.int32()), *t.columns], names=["bin", "part", *names])

    return queries.mapInArrow(mapped, "bin int, part int, " + ", ".join(f"{n} {t}" for n, t in queries.dtypes))


def met(data: DataFrame, queries: DataFrame, kernel: Callable, schema: str, cells: Cells, deal: bool = False) -> DataFrame:
    """kernel's batches for each part of a bin: kernel(data rows, batches of queries), both Arrow tables. A part's data are held, queries pass.

    With deal, queries that are as many as the data are dealt by a hash where parts are too few for the cores, and each deal has the part's data. The number of
    partitions is given, since few bytes are much work here: Spark would put them into few tasks.
    """
    spark = data.sparkSession
    parallel, groups = spark.sparkContext.defaultParallelism, int(cells.parts.sum())
    deals = max(1, min(-(-DEALS * parallel // groups), int(cells.rows.sum()) // DEALT_ROWS)) if deal and groups else 1
    if deals > 1:
        part = F.col("part") * deals
        data = data.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.lit(deals - 1)), lambda d: part + d)))
        queries = queries.withColumn("part", part + F.pmod(F.xxhash64("qid"), F.lit(deals)).cast("int"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(3 * groups * deals, 16 * parallel))
    extra = [c for c in data.columns if c not in ("bin", "part", "id", "v")]
    asked = [c for c in queries.columns if c not in ("bin", "part", "qid", "q")]
    id_type = dict(data.dtypes)["id"]
    left = data.select("bin", "part", F.lit(0).alias("side"), "id", "v", *extra, *[F.lit(None).cast(dict(queries.dtypes)[c]).alias(c) for c in asked])
    right = queries.select("bin", "part", F.lit(1).alias("side"), F.col("qid").cast(id_type).alias("id"), F.col("q").alias("v"), *[F.lit(None).cast(dict(data.dtypes)[c]).alias(c) for c in extra], *asked)
    both = left.unionByName(right).repartition(tasks, "bin", "part").sortWithinPartitions("bin", "part", "side")

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def pieces() -> Iterator:
            for b in batches:
                key = np.stack([b[c].to_numpy() for c in ("bin", "part", "side")])
                cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
                for a, z in zip(cuts, cuts[1:]):
                    if z > a:
                        yield tuple(key[:, a].tolist()), b.slice(a, z - a)

        waiting = pieces()
        following = next(waiting, None)

        def passing(at: tuple) -> Iterator:
            nonlocal following
            while following is not None and following[0] == at:
                yield following[1]
                following = next(waiting, None)

        while following is not None:
            at = following[0]
            if at[2] == 1:
                for _ in passing(at):
                    pass
                continue
            rows = pa.Table.from_batches(list(passing(at))).combine_chunks()
            yield from kernel(rows, passing((*at[:2], 1)))

    return both.mapInArrow(mapped, schema)


#: Distances that a task holds at once, and queries and rows of a product of matrices.
PAIRS, ASKED, HELD = 1 << 20, 512, 2048


class Near:
    """Rows of a matrix, to be asked for those within a distance of others."""

    def __init__(self, x: Any):
        import numpy as np

        self.x, self.middle = x, x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.moved = x - self.middle
        self.scale = (self.moved**2).sum(1)
        self.largest, self.far = float(self.scale.max(initial=0)), float((x * x).sum(1).max(initial=0))
        self.held: dict = {}

    def sides(self, q: Any, limit: Any) -> tuple:
        """(rows for queries, rows for x), whose products are at most 0 where a squared distance is at most the limit: in single precision where its rounding is small
        beside the limit, and less by more than the rounding."""
        import numpy as np

        z, limit = q - self.middle, np.minimum(limit, 1e300)
        own = (z * z).sum(1)
        most, factor = own.max(initial=0) + self.largest, 4 * (q.shape[1] + 8) * np.finfo(np.float32).eps
        single = most + limit.max(initial=0) < 1e30 and max(1e-30, factor * most / 0.02) <= limit.min(initial=np.inf)
        kind = np.float32 if single else np.float64
        if not single:
            factor = 1e-9
        slack = factor * (own + limit) + 1e-12 * ((q * q).sum(1) + self.far)
        if kind not in self.held:
            self.held = {kind: np.column_stack([self.moved, np.ones(len(self.x)), self.scale * (1 - factor)]).astype(kind)}
        return np.column_stack([-2 * z, own - limit - slack, np.ones(len(q))]).astype(kind), self.held[kind]

    def pairs(self, q: Any, limit: Any, among: Any = None) -> tuple:
        """(i, j, d2), by i: row j of x, of those in among, is within the root of limit[i] of q[i]."""
        import numpy as np

        left, right = self.sides(q, limit)
        found = []
        for s in range(0, len(right) if among is None else len(among), HELD):
            rows = right[s : s + HELD] if among is None else right[among[s : s + HELD]]
            hits = np.flatnonzero(left @ rows.T <= 0)
            i, j = np.divmod(hits, max(1, len(rows)))
            found.append((i, j + s if among is None else among[j + s]))
        i, j = (np.concatenate([np.zeros(0, int), *(f[k] for f in found)]) for k in (0, 1))
        by = np.argsort(i, kind="stable")
        i, j = i[by], j[by]
        d2 = np.empty(len(i))
        for s in range(0, len(i), 8192):
            d2[s : s + 8192] = ((q[i[s : s + 8192]] - self.x[j[s : s + 8192]]) ** 2).sum(1)
        keep = d2 <= limit[i]
        return i[keep], j[keep], d2[keep]


def near_pairs(rows: Any, batches: Iterator, most: int | None = None) -> Iterator:
    """(query batch, i, j, d2) for each batch: query i has data row j within its radius. With most, only rows as near as a query's `most` nearest there, ties too."""
    import numpy as np

    x = matrix(rows["v"].chunk(0))
    if most is None or len(x) <= most:
        near = Near(x)
        for whole in batches:
            for at in range(0, whole.num_rows, ASKED):
                b = whole.slice(at, ASKED)
                yield b, *near.pairs(matrix(b["v"]), b["radius"].to_numpy() ** 2)
        return
    scale = (x * x).sum(1)
    largest = float(scale.max(initial=0))
    for whole in batches:
        step = max(1, PAIRS // max(1, len(x)))
        for at in range(0, whole.num_rows, step):
            b = whole.slice(at, step)
            q = matrix(b["v"])
            limit = b["radius"].to_numpy() ** 2
            rough = squares(q, x)
            own = (q * q).sum(1)
            upto = limit[:, None] + 1e-9 * (1 + own[:, None] + scale[None])
            # The rough distances of a query's nearest rows are at most so far beyond the one in that place.
            np.fmin(upto, (np.partition(rough, most - 1, 1)[:, most - 1] + 2e-9 * (1 + own + largest))[:, None], out=upto)
            i, j = np.nonzero(rough <= upto)
            d2 = np.empty(len(i))
            for s in range(0, len(i), 65_536):
                d2[s : s + 65_536] = ((q[i[s : s + 65_536]] - x[j[s : s + 65_536]]) ** 2).sum(1)
            keep = d2 <= limit[i]
            yield b, i[keep], j[keep], d2[keep]


def links(near: Near, q: Any, limit: Any, core: Any, parent: Any) -> tuple:
    """(i, j): for each core query one row of x near it, if any, and for another all of them. parent: a forest of the rows of x, in which a core query ties all rows near it.

    Rows that are tied already are sought only until a query has one of them, so where most rows are one cluster few distances are computed.
    """
    import numpy as np

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    whole, others = np.flatnonzero(core), np.flatnonzero(~core)
    while (up := parent[parent]).tobytes() != parent.tobytes():
        parent[:] = up
    tops = parent.copy()
    tied = tops == np.bincount(tops, minlength=1).argmax() if len(tops) else np.zeros(0, bool)
    i, j, _ = near.pairs(q[others], limit[others])
    found = [(others[i], j)]
    i, j, _ = near.pairs(q[whole], limit[whole], np.flatnonzero(~tied))
    pairs = [(whole[i], j)]
    inside, left, s, width = np.flatnonzero(tied), whole, 0, ASKED
    while s < len(inside) and len(left):
        i, j, _ = near.pairs(q[left], limit[left], inside[s : s + width])
        i, at = np.unique(i, return_index=True)
        pairs.append((left[i], j[at]))
        left, s, width = np.delete(left, i), s + width, 4 * width
    i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    # Of a query's rows in one tree, one is enough.
    _, at = np.unique(np.stack([i, tops[j]]), axis=1, return_index=True) if len(i) else (None, np.zeros(0, int))
    i, j = i[at], j[at]
    first: dict = {}
    for x, y in zip(i.tolist(), j.tolist()):
        if (top := first.setdefault(x, y)) != y:
            parent[root(y)] = root(top)
    return tuple(np.concatenate([o, np.array(list(c), int)]) for o, c in zip(found[0], (first.keys(), first.values())))


def as_queries(points: DataFrame, radius: float, *more: str) -> DataFrame:
    return points.select(F.col("id").alias("qid"), F.col("v").alias("q"), F.lit(float(radius)).alias("radius"), *more)


def named(points: DataFrame, id_col: str, vector_col: str, *more: str | Column) -> DataFrame:
    """id, v of rows with a finite vector."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return points.select(F.col(id_col).alias("id"), v.alias("v"), *more).filter(F.col("v").isNotNull() & ~bad)


def range_join(points: DataFrame, radius: float, id_col: str = "id", vector_col: str = "v", bin_rows: int | None = None) -> DataFrame:
    """(id, other, distance): pairs of rows at most radius apart, the smaller id first. Its size is that of the result."""
    rows = named(points, id_col, vector_col)
    data, cells = indexed(rows, bin_rows)
    kind = dict(rows.dtypes)["id"]

    def kernel(held: Any, batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids = held["id"].chunk(0)
        for b, i, j, d2 in near_pairs(held, batches):
            left, right = b["id"].take(pa.array(i)), ids.take(pa.array(j))
            once = pa.compute.less(left, right)
            yield pa.RecordBatch.from_arrays([left.filter(once), right.filter(once), pa.array(np.sqrt(d2)).filter(once)], names=["id", "other", "distance"])

    return met(data, routed(as_queries(rows, radius), cells), kernel, f"id {kind}, other {kind}, distance double", cells, True)


def knn(data: DataFrame, is_query: Column, k: int, id_col: str = "id", vector_col: str = "v", bin_rows: int | None = None) -> DataFrame:
    """query_id, rank, id, distance: the k nearest rows of each query row (itself included), ties to the smaller id.

    A query's nearest bins give it a radius that holds k rows; then it goes to what may be within that radius, and each part of a bin answers
    with at most k rows.
    """
    rows = named(data, id_col, vector_col)
    queries = named(data.filter(is_query), id_col, vector_col).select(F.col("id").alias("qid"), F.col("v").alias("q"))
    kind = dict(rows.dtypes)["id"]
    held, cells = indexed(rows, bin_rows)

    def kernel(part: Any, batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids = part["id"].chunk(0)
        order = ids.to_pandas().rank(method="first").to_numpy()
        for b, i, j, d2 in near_pairs(part, batches, k):
            by = np.lexsort((order[j], d2, i))
            i, j, d2 = i[by], j[by], d2[by]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            best = place < k
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(i[best])), ids.take(pa.array(j[best])), pa.array(d2[best])], names=["query_id", "id", "d2"])

    schema = f"query_id {kind}, id {kind}, d2 double"
    everything = F.lit(float("inf"))
    asked = queries.withColumn("radius", everything)
    if len(cells.cell) > 1:
        some = met(held, routed(asked, cells, first=k), kernel, schema, cells).groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("d2")), F.lit(k - 1)).alias("d2"))
        bound = F.coalesce(F.sqrt("d2") * (1 + 1e-12), everything)
        asked = cut(queries.join(some.withColumnRenamed("query_id", "qid"), "qid", "left").select("qid", "q", bound.alias("radius")))
    near = met(held, routed(asked, cells), kernel, schema, cells)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "id"))
    return near.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "id", F.sqrt("d2").alias("distance"))


def dbscan(points: DataFrame, radius: float, least: int, id_col: str = "id", vector_col: str = "v", bin_rows: int | None = None) -> DataFrame:
    """(id, near, cluster) for every row: near counts the other rows within the radius; a row with at least `least` of them is core. A cluster is named by its
    smallest core id, a border row takes the smallest cluster among its core neighbours, noise has none. Rows without a finite vector are noise.

    Equal vectors are one point with a weight. Pairs never leave a task: it counts them, then sends a spanning forest of its core pairs, and for a border
    point its core neighbours, which are fewer than `least`.
    """
    rows = named(points, id_col, vector_col)
    distinct = cut(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    kind = dict(rows.dtypes)["id"]
    data, cells = indexed(distinct, bin_rows)

    def counting(held: Any, batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        weight = held["n"].to_numpy()
        for b, i, j, _ in near_pairs(held, batches):
            total = np.bincount(i, weight[j], b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(total)], names=["id", "n"])

    def linking(held: Any, batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids = held["id"].chunk(0)
        parent, near = np.arange(len(ids)), Near(matrix(held["v"].chunk(0)))
        for whole in batches:
            for at in range(0, whole.num_rows, ASKED):
                b = whole.slice(at, ASKED)
                core = b["core"].to_numpy(zero_copy_only=False).astype(bool)
                i, j = links(near, matrix(b["v"]), b["radius"].to_numpy() ** 2, core, parent)
                yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(i)), ids.take(pa.array(j)), pa.array(core[i])], names=["a", "b", "core"])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
        moved = np.flatnonzero(parent != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(moved)), ids.take(pa.array(parent[moved])), pa.array(np.ones(len(moved), bool))], names=["a", "b", "core"])

    counts = met(data, routed(as_queries(distinct, radius), cells), counting, f"id {kind}, n long", cells, True).groupBy("id").agg((F.sum("n") - 1).alias("near"))
    counts = cut(counts)
    marked = data.join(counts, "id").withColumn("core", F.col("near") >= least)
    asked = as_queries(distinct.join(counts, "id").withColumn("core", F.col("near") >= least), radius, "core")
    tied = cut(met(marked.filter("core").drop("n", "near", "core"), routed(asked, cells), linking, f"a {kind}, b {kind}, core boolean", cells, True))
    roots = components(tied.filter("core").select("a", "b"))
    labels = counts.filter(F.col("near") >= least).select("id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))
    border = tied.filter("NOT core").join(labels.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))
    found = counts.join(labels.unionByName(border), "id", "left")
    by_vector = distinct.join(found, "id").select("v", "near", "cluster")
    all_rows = points.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    return all_rows.join(by_vector, "v", "left").select("id", F.coalesce("near", F.lit(0).cast("long")).alias("near"), "cluster")
