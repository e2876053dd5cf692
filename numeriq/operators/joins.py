"""Distance joins, sparse products and lookups."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import squared_distance
from ..plans.lineage import cut


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of a query's k true neighbours that were found."""
    hits = found.join(truth.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    asked = truth.select("query_id").distinct()
    return asked.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.lit(k)).alias("recall"))


def majority_vote(neighbours: DataFrame, label: str) -> DataFrame:
    """(query_id, prediction): the commonest label, ties to the smallest."""
    n = neighbours.groupBy("query_id", label).agg(F.count("*").alias("n"))
    return n.groupBy("query_id").agg(F.max_by(label, F.struct("n", -F.col(label))).alias("prediction"))


def nearest_centre(points: DataFrame, centres: list[tuple[int, list[float]]], vector_col: str = "v") -> DataFrame:
    """centre and d2 for each point; the lowest centre wins ties. Centres are parameters of a model: k rows, in the plan itself."""
    each = [F.struct(squared_distance(F.col(vector_col), F.array(*map(F.lit, c))).alias("d2"), F.lit(i).alias("centre")) for i, c in centres]
    best = F.array_min(F.array(*each))
    return points.withColumn("__b", best).withColumn("centre", F.col("__b.centre")).withColumn("d2", F.col("__b.d2")).drop("__b")


def lattice_neighbours(cells: DataFrame, x: str, y: str, weight: str, radius: int) -> DataFrame:
    """(x, y, weight, near): the weight within a Euclidean radius of each lattice point, itself excluded.

    Points are combined by lattice cell first; each cell then goes to the fixed number of offsets in reach, so the join is an equi-join
    and its size is linear in the distinct points.
    """
    offsets = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    grid = cells.groupBy(x, y).agg(F.sum(weight).alias("w"))
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])).alias("m")
    reach = grid.select(x, y, "w", moves).select((F.col(x) + F.col("m.a")).alias(x), (F.col(y) + F.col("m.b")).alias(y), "w").groupBy(x, y).agg(F.sum("w").alias("near"))
    return grid.join(reach, [x, y]).select(x, y, F.col("w").alias("weight"), (F.col("near") - 1).alias("near"))


def lattice_edges(points: DataFrame, x: str, y: str, radius: int) -> DataFrame:
    """Pairs (x, y, x2, y2) of different lattice points within the radius."""
    offsets = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if 0 < a * a + b * b <= radius * radius]
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])).alias("m")
    sent = points.select(x, y, moves).select(F.col(x), F.col(y), (F.col(x) + F.col("m.a")).alias("x2"), (F.col(y) + F.col("m.b")).alias("y2"))
    return sent.join(points.select(F.col(x).alias("x2"), F.col(y).alias("y2")), ["x2", "y2"], "left_semi").select(x, y, "x2", "y2")


def stencil(grid: DataFrame, r: str = "r", c: str = "c", v: str = "v") -> DataFrame:
    """Each cell with its four neighbours n, s, w, e by coordinates; where there is no such cell, the cell is its own neighbour.

    A cell's value is sent to its neighbours, and its row to its own place: one shuffle by cell, in which no line of the grid is a key. (r, c) is unique.
    """
    moves = {"n": (1, 0), "s": (-1, 0), "w": (0, 1), "e": (0, -1)}
    sent = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in (moves | {"own": (0, 0)}).items()])).alias("m")
    own = F.struct(*grid.columns)
    moved = grid.select(own.alias("row"), F.col(v).alias("x"), sent).select((F.col(f"row.{r}") + F.col("m.a")).alias("__r"), (F.col(f"row.{c}") + F.col("m.b")).alias("__c"), F.when(F.col("m.k") == "own", F.col("row")).alias("row"), "x", F.col("m.k").alias("k"))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("x")))
    met = moved.groupBy("__r", "__c").agg(F.max_by("row", F.when(F.col("k") == "own", 1)).alias("row"), *[at(k).alias(k) for k in moves]).filter("row is not null")
    return met.select("row.*", *[F.coalesce(k, F.col(f"row.{v}")).alias(k) for k in moves])


#: Bytes of vectors that are sent to every task, and entries of a matrix that a task sorts where they are more.
SENT_BYTES, TASK_ENTRIES = 64 << 20, 500_000


def meet(a: DataFrame, x: DataFrame, on: str, numbers: int = 1, entries: DataFrame | None = None) -> DataFrame:
    """Entries of a matrix with their row of x, which has one row of so many numbers for each value of `on`.

    The rows of x are counted, so it should be a table, not Spark's guess of its size: up to SENT_BYTES it goes to every task. Beyond, both are dealt in as many
    parts as bound what a task sorts; entries: a table that has at least as many rows as a, to be counted in its place.
    """
    if x.count() * 8 * (numbers + 4) <= SENT_BYTES:
        return a.join(F.broadcast(x), on)
    parts = max(a.sparkSession.sparkContext.defaultParallelism, -(-(a if entries is None else entries).count() // TASK_ENTRIES))
    return a.repartition(parts, on).join(x.repartition(parts, on).hint("merge"), on)


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """(i, x) of A x. a: (i, j, v); x: (i, x)."""
    return a.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def stored_matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """matvec of tables, with a bound on what a task holds of either."""
    return meet(a, x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


#: Rows and columns of a block of a matrix, and products of elements beyond which two blocks are multiplied as full ones.
BLOCK, DENSE = 1024, 1 << 20

#: Blocks on a side of a tile of a product, at most, and bytes of blocks that a task sorts.
TILE, TASK_BYTES = 4, 64 << 20


def squeezed(x: Any) -> bytes:
    """Numbers as bytes, compressed by place in the number: ascending places, as differences, and repeating values take about a byte an element."""
    import numpy as np
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)


def spread(data: Any, kind: Any, n: int) -> Any:
    """n numbers that were squeezed."""
    import numpy as np
    import pyarrow as pa

    size = np.dtype(kind).itemsize
    held = np.frombuffer(pa.decompress(data, n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(held.reshape(size, n).T).reshape(-1).view(kind)


def packed(a: DataFrame, row: str, column: str, width: int | None = None) -> DataFrame:
    """(row, column, n, at, v): a row for each block of a matrix (i, j, v), with its n elements' places in the block (row * width + column; BLOCK if not said), ascending, as squeezed differences, and their squeezed values."""
    width = width or BLOCK
    placed = a.select(*[F.floor(F.col(c) / width).cast("long").alias(n) for c, n in (("i", row), ("j", column))], (F.pmod("i", F.lit(width)) * width + F.pmod("j", F.lit(width))).cast("int").alias("at"), F.col("v").cast("double").alias("v"))

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def block(key, held):
            at, v = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            order = np.argsort(at, kind="stable")
            columns = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([len(at)], pa.int32())]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([squeezed(x)], pa.binary()) for x in (np.diff(at[order], prepend=np.int32(0)), v[order]))], names=[row, column, "n", "at", "v"])

        last, held = None, []
        for b in batches:
            key = np.stack([b.column(k).to_numpy() for k in (0, 1)])
            at, v = b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    now = tuple(key[:, s].tolist())
                    if held and now != last:
                        yield block(last, held)
                        held = []
                    last = now
                    held.append((at[s:e].copy(), v[s:e].copy()))
        if held:
            yield block(last, held)

    return placed.repartition(row, column).sortWithinPartitions(row, column).mapInArrow(mapped, f"{row} long, {column} long, n int, at binary, v binary")


def tiled(left: DataFrame, right: DataFrame) -> DataFrame:
    """(ti, tj, bk, side, b, n, at, v): tables of blocks, of left (b, bk) and right (bk, b), sent to the tiles of their product, tile by tile and bk by bk, left before right.

    A tile has as many blocks on a side, up to TILE, as leave three tiles for each core.
    """
    parallel = left.sparkSession.sparkContext.defaultParallelism
    lines = [t.agg(F.count_distinct("b")).first()[0] for t in (left, right)]
    side = max(1, min(TILE, math.isqrt(lines[0] * lines[1] // (3 * parallel))))
    left, right = (t.withColumn("t", F.floor(F.col("b") / side)) for t in (left, right))
    # Blocks are small by their rows and large by their bytes: neither side is broadcast.
    by_k = [t.groupBy("bk").agg(F.count_distinct("t").alias(f"t{k}"), F.sum(F.octet_length("at") + F.octet_length("v")).alias(f"s{k}")) for k, t in enumerate((left, right))]
    size = by_k[0].join(by_k[1].hint("merge"), "bk").agg(F.sum(F.col("s0") * F.col("t1") + F.col("s1") * F.col("t0"))).first()[0] or 0
    parts = max(-(-int(size) // TASK_BYTES), parallel, min(8 * parallel, -(-lines[0] // side) * -(-lines[1] // side)))
    tiles = [cut(t.select("bk", F.col("t").alias("other")).distinct()).hint("merge") for t in (right, left)]
    at = (("t", "other"), ("other", "t"))
    sent = [t.join(tiles[k], "bk").select(F.col(at[k][0]).alias("ti"), F.col(at[k][1]).alias("tj"), "bk", F.lit(k).alias("side"), "b", "n", "at", "v") for k, t in enumerate((left, right))]
    return sent[0].unionByName(sent[1]).repartition(parts, "ti", "tj").sortWithinPartitions("ti", "tj", "bk", "side")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of A B, for matrices (i, j, v) of whole-number places whose values are there; elements of one place add up.

    Both are stored as blocks. The product is made in tiles of a few blocks: a block is sent once to each tile of its row or column that its partners lie in, and a
    task adds up one tile at a time, full blocks as matrices and sparse ones element by element: products of elements are never rows. An element is in the result
    if any pair of elements meets there, though it be 0.
    """
    spark = a.sparkSession
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20
    if not 0 < int(spark.conf.get(name).removesuffix("b")) <= most:
        spark.conf.set(name, str(most))  # blocks are long rows
    left = cut(packed(a, "b", "bk"))
    right = left.select(F.col("b").alias("bk"), F.col("bk").alias("b"), "n", "at", "v") if b is a else cut(packed(b, "bk", "b"))
    met = tiled(left, right)

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        class Block:
            """Elements in the order of rows; as a matrix, and where they are, if asked."""

            def __init__(self, line, n, at, v):
                self.line, self.v = line, spread(v, np.float64, n)
                self.rows, self.columns = np.divmod(np.cumsum(spread(at, np.int32, n), dtype=np.int32), np.int32(BLOCK))
                self.finite, self.full = bool(np.isfinite(self.v).all()), None

            def starts(self):
                return np.searchsorted(self.rows, np.arange(BLOCK + 1))

            def matrices(self):
                if self.full is None:
                    there = np.zeros((BLOCK, BLOCK), np.float32)
                    there[self.rows, self.columns] = 1
                    self.full = np.bincount(self.rows * BLOCK + self.columns, self.v, BLOCK * BLOCK).reshape(BLOCK, BLOCK), there
                return self.full

        def add(total, seen, a, b, starts):
            counts = (starts[1:] - starts[:-1])[a.columns]
            upto = np.cumsum(counts)
            if not len(upto) or not upto[-1]:
                return
            if upto[-1] > DENSE and a.finite and b.finite:
                (x, p), (y, q) = a.matrices(), b.matrices()
                total += x @ y
                seen |= (p @ q) > 0
                return
            flat, was = total.reshape(-1), seen.reshape(-1)
            first = starts[a.columns] - (upto - counts)
            s = 0
            while s < len(upto):
                before = upto[s - 1] if s else 0
                e = max(s + 1, int(np.searchsorted(upto, before + DENSE, "right")))
                n = counts[s:e]
                p = np.arange(before, upto[e - 1]) + np.repeat(first[s:e], n)
                place = np.repeat(a.rows[s:e] * BLOCK, n) + b.columns[p]
                np.add.at(flat, place, np.repeat(a.v[s:e], n) * b.v[p])
                was[place] = True
                s = e

        def rows_of(tile):
            for (i, j), (total, seen) in sorted(tile.items()):
                at = np.flatnonzero(seen)
                for s in range(0, len(at), 65_536):
                    p = at[s : s + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array(i * BLOCK + p // BLOCK), pa.array(j * BLOCK + p % BLOCK), pa.array(total.reshape(-1)[p])], names=["i", "j", "v"])

        last, k, held, tile = None, None, [], {}
        for batch in batches:
            ti, tj, bk, second, line, n = (batch.column(c).to_pylist() for c in range(6))
            for x in range(batch.num_rows):
                if (ti[x], tj[x]) != last:
                    yield from rows_of(tile)
                    last, k, tile = (ti[x], tj[x]), None, {}
                if bk[x] != k:
                    k, held = bk[x], []
                now = Block(line[x], n[x], batch.column(6)[x].as_buffer(), batch.column(7)[x].as_buffer())
                if not second[x]:
                    held.append(now)
                    continue
                starts = now.starts()
                for other in held:
                    key = other.line, now.line
                    if key not in tile:
                        tile[key] = np.zeros((BLOCK, BLOCK)), np.zeros((BLOCK, BLOCK), bool)
                    add(*tile[key], other, now, starts)
        yield from rows_of(tile)

    return met.mapInArrow(mapped, "i long, j long, v double")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def mirror(a: DataFrame) -> DataFrame:
    """A triangle's entries and, off the diagonal, their mirror images."""
    return a.unionByName(transpose(a.filter("i <> j")))


def is_symmetric(a: DataFrame) -> DataFrame:
    """(entries, unmatched): entries without a mirror image of the same value."""
    odd = a.join(transpose(a), ["i", "j", "v"], "left_anti")
    return a.agg(F.count("*").alias("entries")).withColumn("unmatched", odd.agg(F.count("*")).scalar())


def asof_lookup(points: DataFrame, steps: DataFrame, by: str, at: str, value: str, inclusive: bool = True) -> DataFrame:
    """Each point with the value of the last step at or before it (of its group): one union and one window, no range join."""
    p = points.withColumns({"__kind": F.lit(1 if inclusive else 0), "__v": F.lit(None).cast(dict(steps.dtypes)[value])})
    s = steps.select(by, at, F.col(value).alias("__v")).withColumn("__kind", F.lit(0 if inclusive else 1)).withColumn("__step", F.lit(True))
    both = p.withColumn("__step", F.lit(False)).unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).filter("NOT __step").drop("__kind", "__v", "__step")


def gather_neighbours(elements: DataFrame, key: str, neighbours: list[str], value: str) -> DataFrame:
    """(key, value, total, boundary): the sum of value over the neighbours named in columns, and how many of them don't exist."""
    links = elements.select(key, F.explode(F.array(*neighbours)).alias("__n"))
    held = elements.select(F.col(key).alias("__n"), F.col(value).alias("__v"))
    sums = links.join(held, "__n", "left").groupBy(key).agg(F.sum("__v").alias("total"), F.count_if(F.col("__v").isNull()).alias("boundary"))
    return elements.select(key, value).join(sums, key).withColumn("total", F.coalesce("total", F.lit(0.0)))
