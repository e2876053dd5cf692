"""Krylov iterations on vectors in blocks, for systems whose vectors are too long to be sent to every task.

A vector (b, n, at, x) has a row for each block of WIDTH places: its n places in the block, ascending, as squeezed differences, and their values as bytes; a
matrix has a row for each block that holds anything (`joins.packed`). So a product ships a byte or two for an element of the matrix, and a vector's values
once to the rows of blocks that ask for them and once to be added up. The basis of GMRES is shipped and stored once an iteration; scalars alone come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .joins import packed, spread, squeezed

#: Places of a block: so many squared must fit 32 bits.
WIDTH = 32_768

VECTOR = "b long, n int, at binary, x binary"


def places(at: Any, n: int) -> Any:
    import numpy as np

    return np.cumsum(spread(at, np.int32, n), dtype=np.int32)


def batch(b: list, at: list, x: list) -> Any:
    """Rows of a vector, of places that are squeezed already and of values."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array([len(v) for v in x], pa.int32()), pa.array(at, pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["b", "n", "at", "x"])


def blocked(v: DataFrame) -> DataFrame:
    """A vector (i, x) in blocks; elements of one place add up."""
    placed = v.select(F.floor(F.col("i") / WIDTH).cast("long").alias("b"), F.pmod("i", F.lit(WIDTH)).cast("int").alias("p"), F.col("x").cast("double").alias("x"))
    width = WIDTH

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np

        def pieces() -> Iterator:
            for t in batches:
                b, p, x = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy()
                cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
                for s, e in zip(cuts, cuts[1:]):
                    if e > s:
                        yield int(b[s]), p[s:e].copy(), x[s:e].copy()

        yield from added(pieces(), width)

    return placed.repartition("b").sortWithinPartitions("b").mapInArrow(mapped, VECTOR)


def added(pieces: Iterator, width: int) -> Iterator:
    """Batches of a vector, from (block, places, values) in the order of blocks."""
    import numpy as np

    last, total, seen = None, None, None

    def row() -> Any:
        at = np.flatnonzero(seen)
        return batch([last], [squeezed(np.diff(at.astype(np.int32), prepend=np.int32(0)))], [total[at]])

    for b, p, x in pieces:
        if b != last:
            if last is not None:
                yield row()
            last, total, seen = b, np.zeros(width), np.zeros(width, bool)
        total += np.bincount(p, x, width)
        seen[p] = True
    if last is not None:
        yield row()


def unblocked(v: DataFrame) -> DataFrame:
    """(i, x) of a vector in blocks."""
    width = WIDTH

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for t in batches:
            for b, n, at, x in zip(t["b"].to_pylist(), t["n"].to_pylist(), t["at"].to_pylist(), t["x"].to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(b * width + places(at, n).astype(np.int64)), pa.array(np.frombuffer(x))], names=["i", "x"])

    return v.mapInArrow(mapped, "i long, x double")


def matrix(a: DataFrame) -> DataFrame:
    """The blocks of a matrix (i, j, v), as a table."""
    return cut(packed(a, "r", "b", WIDTH).withColumnsRenamed({"n": "m", "at": "place", "v": "v"}))


def product(a: DataFrame, x: DataFrame) -> DataFrame:
    """A x, of a matrix and a vector in blocks."""
    width = WIDTH

    def multiplied(batches: Iterator) -> Iterator:
        import numpy as np

        for t in batches:
            for r, m, place, v, n, at, x in zip(*(t[c].to_pylist() for c in ("r", "m", "place", "v", "n", "at", "x"))):
                held = np.zeros(width)
                held[places(at, n)] = np.frombuffer(x)
                row, column = np.divmod(places(place, m), np.int32(width))
                firsts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                yield batch([r], [squeezed(np.diff(row[firsts], prepend=np.int32(0)))], [np.add.reduceat(spread(v, np.float64, m) * held[column], firsts)])

    def summed(batches: Iterator) -> Iterator:
        import numpy as np

        yield from added(((b, places(at, n), np.frombuffer(x)) for t in batches for b, n, at, x in zip(*(t[c].to_pylist() for c in ("b", "n", "at", "x")))), width)

    met = a.hint("merge").join(x, "b").select("r", "m", "place", "v", "n", "at", "x").mapInArrow(multiplied, VECTOR)
    return met.repartition("b").sortWithinPartitions("b").mapInArrow(summed, VECTOR)


def combined(x: DataFrame, k: float, y: DataFrame) -> DataFrame:
    """x + k y."""
    width = WIDTH

    def summed(batches: Iterator) -> Iterator:
        import numpy as np

        yield from added(((b, places(at, n), w * np.frombuffer(v)) for t in batches for b, n, at, v, w in zip(*(t[c].to_pylist() for c in ("b", "n", "at", "x", "w")))), width)

    both = x.withColumn("w", F.lit(1.0)).unionByName(y.withColumn("w", F.lit(float(k))))
    return both.repartition("b").sortWithinPartitions("b").mapInArrow(summed, VECTOR)


def of_basis(t: DataFrame, f: Any, schema: str) -> DataFrame:
    """f(rows of the basis) -> values by column, for each block: t (b, n, at, q, x) has vectors one after another in q, and the one that is being added in x."""
    names = [c.split()[0] for c in schema.split(", ")]

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds = {"b": pa.int64(), "n": pa.int32(), "g": pa.list_(pa.float64())}
        for s in batches:
            for b, n, at, q, x in zip(*(s[c].to_pylist() for c in ("b", "n", "at", "q", "x"))):
                new = f(np.frombuffer(q).reshape(-1, n), np.frombuffer(x))
                held = {"b": b, "n": n, "at": at} | {k: v.tobytes() if k in ("q", "x") else v for k, v in new.items()}
                yield pa.RecordBatch.from_arrays([pa.array([held[k]], kinds.get(k, pa.binary())) for k in names], names=names)

    return t.mapInArrow(mapped, schema)


def gmres(a: DataFrame, b: DataFrame, restart: int = 20, cycles: int = 5, tolerance: float = 1e-8, factors: list[DataFrame] | None = None, reduced: tuple[DataFrame, ...] | None = None) -> tuple[DataFrame, list[float]]:
    """(solution (i, x), history): `solvers.gmres` on blocks, preconditioned by a product of matrices, the first of factors first (`precondition.lu_factors`).

    reduced, in place of factors (`precondition.two_colours`): the iteration runs on half of the unknowns, and so do residuals.

    a: (i, j, v) with an element in each row, and b: (i, x), have the same rows.
    """
    import numpy as np

    spark = a.sparkSession
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20
    if not 0 < int(spark.conf.get(name).removesuffix("b")) <= most:
        spark.conf.set(name, str(most))  # blocks are long rows
    whole, right = matrix(a), cut(blocked(b))
    if reduced:
        own, condensed, spread_out, back = map(matrix, reduced)
        first, operator = [condensed], [spread_out, back]
    else:
        first = [matrix(f) for f in factors or []]
        operator = [whole, *first]

    def through(parts: list, v: DataFrame) -> DataFrame:
        for p in parts:
            v = product(p, v)
        return v

    def sums(t: DataFrame, f: Any) -> Any:
        """f's numbers, added up over all blocks."""
        each = of_basis(t, lambda q, w: {"g": f(q, w).tolist()}, "g array<double>").select(F.posexplode("g").alias("k", "g"))
        return np.array([r["g"] for r in each.groupBy("k").agg(F.sum("g").alias("g")).orderBy("k").collect()])

    x, history = None, []
    for _ in range(cycles):
        r = right if x is None else combined(right, -1.0, product(whole, x))
        if reduced:
            r = cut(r)
            x = product(own, r) if x is None else combined(x, 1.0, product(own, r))
        t = cut(through(first, r).withColumn("q", F.lit(b"")))
        (ww,) = sums(t, lambda q, w: np.array([w @ w])) if not t.isEmpty() else (0.0,)
        beta = math.sqrt(ww)
        if beta < tolerance:
            break
        h, size, g, length = np.zeros((restart + 1, restart)), 0, np.zeros(0), beta
        y = np.zeros(0)
        while True:
            # The vector being added, less its part along the others, over its length, ends the basis.
            last = lambda q, w, g=g, length=length: (w - g @ q) / length
            basis = of_basis(t, lambda q, w, last=last: {"q": np.vstack([q, last(q, w)])}, "b long, n int, at binary, q binary")
            newest = of_basis(t, lambda q, w, last=last: {"x": last(q, w)}, VECTOR)
            if size == restart or (size and (history[-1] < tolerance or length < 1e-14)):
                break
            k = size
            t = cut(basis.hint("merge").join(through(operator, newest).select("b", "x"), "b").select("b", "n", "at", "q", "x"))
            g = sums(t, lambda q, w: q @ w)
            *more, ww = sums(t, lambda q, w, g=g: np.append(q @ (w - g @ q), (w - g @ q) @ (w - g @ q)))
            g = g + np.array(more)
            length = math.sqrt(max(0.0, ww - float(np.dot(more, more))))
            h[: k + 1, k], h[k + 1, k], size = g, length, k + 1
            e = np.zeros(size + 1)
            e[0] = beta
            y, *_ = np.linalg.lstsq(h[: size + 1, :size], e, rcond=None)
            history.append(float(np.linalg.norm(h[: size + 1, :size] @ y - e)))
            if length < 1e-14:
                break
        step = of_basis(t, lambda q, w, y=y: {"x": y @ q}, VECTOR)
        step = product(spread_out, step) if reduced else step
        x = cut(step if x is None else combined(x, 1.0, step))
        if history[-1] < tolerance:
            break
    return (b.select("i", F.lit(0.0).alias("x")) if x is None else unblocked(x)), history
