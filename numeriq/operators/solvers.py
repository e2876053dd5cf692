"""Iterative solvers on sparse matrices (i, j, v) and vectors (i, x): every step is joins and sums; scalars alone come to the driver.

After each iteration the vectors are checkpointed, so that plans stay short and a lost executor costs one step.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .joins import stored_matvec as matvec


def dot(a: DataFrame, b: DataFrame) -> float:
    return a.select("i", F.col("x").alias("a")).join(b.select("i", F.col("x").alias("b")), "i").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0


def combine(a: DataFrame, k: float, b: DataFrame) -> DataFrame:
    """a + k b; a missing element is 0."""
    return a.unionByName(b.select("i", (F.col("x") * k).alias("x"))).groupBy("i").agg(F.sum("x").alias("x"))


def diagonal(a: DataFrame) -> DataFrame:
    return a.filter("i = j").select("i", F.col("v").alias("d"))


def diagonal_stats(a: DataFrame) -> DataFrame:
    d = a.filter("i = j")
    return d.agg(F.min(F.abs("v")).alias("least"), F.max(F.abs("v")).alias("most"), F.count_if(F.col("v") == 0).alias("zeros"))


def scaled(r: DataFrame, d: DataFrame) -> DataFrame:
    return r.join(d, "i").select("i", (F.col("x") / F.col("d")).alias("x"))


def row_sums(a: DataFrame) -> DataFrame:
    """A times the vector of ones."""
    return a.groupBy("i").agg(F.sum("v").alias("x"))


def jacobi_step(a: DataFrame, b: DataFrame, x: DataFrame) -> DataFrame:
    """x' = D^-1 (b - (A - D) x)."""
    off = matvec(a.filter("i <> j"), x).select("i", F.col("x").alias("s"))
    return b.select("i", F.col("x").alias("b")).join(diagonal(a), "i").join(off, "i", "left").select("i", ((F.col("b") - F.coalesce("s", F.lit(0.0))) / F.col("d")).alias("x"))


def jacobi(a: DataFrame, b: DataFrame, iterations: int = 100, tolerance: float = 1e-6) -> tuple[DataFrame, list[float]]:
    """(solution, history of relative residuals).

    A step gives the residual of the vector that it starts from, d (x' - x), so an iteration is one product. a and b are read in each and should be tables.
    """
    x, history = b.select("i", F.lit(0.0).alias("x")), []
    norm = math.sqrt(dot(b, b)) or 1.0
    d, old = diagonal(a), x
    for n in range(iterations):
        new = jacobi_step(a, b, x).join(x.select("i", F.col("x").alias("o")), "i").join(d, "i")
        new = cut(new.select("i", "x", ((F.col("x") - F.col("o")) * F.col("d")).alias("r")))
        left = math.sqrt(new.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0) / norm
        if n:
            history.append(left)
            if left < tolerance:
                return old, history
        old = x = new.select("i", "x")
    r = combine(b, -1.0, matvec(a, x))
    history.append(math.sqrt(dot(r, r)) / norm)
    return x, history


def totals(t: DataFrame, **sums) -> list[float]:
    """Sums over a table of vectors, in one pass."""
    return [x or 0.0 for x in t.agg(*[F.sum(c).alias(n) for n, c in sums.items()]).first()]


def with_product(a: DataFrame, t: DataFrame, column, name: str) -> DataFrame:
    """t with A times a column of it, as a table: what an iteration computes; all else is projections of it."""
    q = matvec(a, t.select("i", column.alias("x"))).select("i", F.col("x").alias(name))
    return cut(t.join(q, "i", "left").withColumn(name, F.coalesce(name, F.lit(0.0))))


def conjugate_gradient(a: DataFrame, b: DataFrame, iterations: int = 100, tolerance: float = 1e-8, breakdown: float = 1e-300) -> tuple[DataFrame, list[float]]:
    """Preconditioned by the diagonal; stops on the preconditioned residual, relative to |b|. All vectors are columns of one table."""
    x, r, p, d, q = map(F.col, "xrpdq")
    t = cut(b.select("i", F.lit(0.0).alias("x"), F.col("x").alias("r")).join(diagonal(a), "i").withColumn("p", r / d))
    rz, norm = totals(t, rz=r * r / d, bb=r * r)
    norm, history = math.sqrt(norm) or 1.0, []
    for _ in range(iterations):
        t = with_product(a, t, p, "q")
        (pq,) = totals(t, pq=p * q)
        if abs(pq) < breakdown:
            break
        alpha = rz / pq
        t = t.withColumns({"x": x + alpha * p, "r": r - alpha * q}).drop("q")
        old, (rz, zz) = rz, totals(t, rz=r * r / d, zz=(r / d) * (r / d))
        history.append(math.sqrt(zz) / norm)
        if history[-1] < tolerance:
            break
        t = t.withColumn("p", r / d + (rz / old) * p)
    return t.select("i", "x"), history


def bicgstab(a: DataFrame, b: DataFrame, iterations: int = 100, tolerance: float = 1e-8) -> tuple[DataFrame, list[float]]:
    """Preconditioned by the diagonal; the tolerance is absolute. All vectors are columns of one table."""
    x, r, p, d, v, shadow, u = map(F.col, ("x", "r", "p", "d", "v", "shadow", "u"))
    zero = F.lit(0.0)
    t = cut(b.select("i", zero.alias("x"), F.col("x").alias("r"), F.col("x").alias("shadow"), zero.alias("p"), zero.alias("v")).join(diagonal(a), "i"))
    alpha = omega = old = 1.0
    (rho,) = totals(t, rho=shadow * r)
    history: list[float] = []
    for _ in range(iterations):
        if rho == 0:
            break
        t = t.withColumn("p", r + (rho / old * alpha / omega) * (p - omega * v)).drop("v")
        t = with_product(a, t, p / d, "v")
        (sv,) = totals(t, sv=shadow * v)
        alpha = rho / sv
        t = t.withColumn("r", r - alpha * v)
        t = with_product(a, t, r / d, "u")
        uu, ur = totals(t, uu=u * u, ur=u * r)
        omega = ur / uu if uu else 0.0
        t = t.withColumns({"x": x + alpha * (p / d) + omega * (r / d), "r": r - omega * u}).drop("u")
        old, (rr, rho) = rho, totals(t, rr=r * r, rho=shadow * r)
        history.append(math.sqrt(rr))
        if history[-1] < tolerance or omega == 0:
            break
    return t.select("i", "x"), history


def gmres(a: DataFrame, b: DataFrame, restart: int = 20, cycles: int = 5, tolerance: float = 1e-8, precondition=None) -> tuple[DataFrame, list[float]]:
    """Restarted, preconditioned by the diagonal or by precondition(r (i, x)) -> (i, x), such as precondition.lu_solver(a). The basis is an array column, orthogonalised twice; the driver holds the (restart + 1) x restart Hessenberg matrix."""
    import numpy as np

    d, w, q = F.col("d"), F.col("w"), F.col("q")

    def prepared(t: DataFrame) -> DataFrame:
        if precondition is None:
            return t.withColumn("w", w / d)
        z = precondition(t.select("i", w.alias("x")))
        return cut(t.drop("w").join(z.select("i", F.col("x").alias("w")), "i"))

    t = cut(b.select("i", F.lit(0.0).alias("x"), F.col("x").alias("b")).join(diagonal(a), "i"))
    history: list[float] = []
    for _ in range(cycles):
        t = prepared(with_product(a, t, F.col("x"), "w").withColumn("w", F.col("b") - w))
        (beta,) = totals(t, ww=w * w)
        beta = math.sqrt(beta)
        if beta < tolerance:
            break
        t = t.withColumn("q", F.array(w / beta)).drop("w")
        h, size, y = np.zeros((restart + 1, restart)), 0, np.zeros(0)
        for k in range(restart):
            t = prepared(with_product(a, t, q[k], "w"))
            for _ in range(2):
                g = totals(t, **{f"g{i}": q[i] * w for i in range(k + 1)})
                h[: k + 1, k] += g
                away = F.lit(0.0)
                for i in range(k + 1):
                    away = away + float(g[i]) * q[i]
                t = t.withColumn("w", w - away)
            (ww,) = totals(t, ww=w * w)
            h[k + 1, k], size = math.sqrt(ww), k + 1
            e = np.zeros(size + 1)
            e[0] = beta
            y, *_ = np.linalg.lstsq(h[: size + 1, :size], e, rcond=None)
            history.append(float(np.linalg.norm(h[: size + 1, :size] @ y - e)))
            if history[-1] < tolerance or h[k + 1, k] < 1e-14:
                break
            t = t.withColumn("q", F.concat(q, F.array(w / float(h[k + 1, k])))).drop("w")
        step = F.lit(0.0)
        for i in range(size):
            step = step + float(y[i]) * q[i]
        t = t.withColumn("x", F.col("x") + step).select("i", "x", "b", "d")
        if history[-1] < tolerance:
            break
    return t.select("i", "x"), history


def refine(a: DataFrame, b: DataFrame, solve, steps: int = 3, low=None, tolerance: float = 0.0) -> tuple[DataFrame, list[float]]:
    """Iterative refinement: residuals in double, corrections by `solve(a, r)`, which may hold its numbers in a lower format (low: Column -> Column), in which the matrix is stored once."""
    held = cut(a.select("i", "j", low(F.col("v")).alias("v"))) if low else a
    x, history = b.select("i", F.lit(0.0).alias("x")), []
    for _ in range(steps):
        r = cut(combine(b, -1.0, matvec(a, x)))
        history.append(math.sqrt(dot(r, r)))
        if history[-1] < tolerance:
            break
        x = cut(combine(x, 1.0, solve(held, r)))
    return x, history


def red_black_sweep(a: DataFrame, b: DataFrame, x: DataFrame, omega: float = 1.0) -> DataFrame:
    """One sweep of Gauss-Seidel or successive over-relaxation in two colours: even rows first, then odd rows with the new even values."""
    for colour in (0, 1):
        mine = F.pmod("i", F.lit(2)) == colour
        new = jacobi_step(a.filter(mine), b.filter(mine), x).select("i", F.col("x").alias("n"))
        x = cut(x.join(new, "i", "left").select("i", F.when(F.col("n").isNull(), F.col("x")).otherwise((1 - omega) * F.col("x") + omega * F.col("n")).alias("x")))
    return x


def relax(a: DataFrame, b: DataFrame, omega: float = 1.0, sweeps: int = 100, tolerance: float = 1e-6) -> tuple[DataFrame, list[float]]:
    """(solution, history of the largest change) of two-colour sweeps, until a sweep changes no element by the tolerance."""
    x, history = b.select("i", F.lit(0.0).alias("x")), []
    for _ in range(sweeps):
        new = red_black_sweep(a, b, x, omega)
        history.append(new.join(x.select("i", F.col("x").alias("o")), "i").agg(F.max(F.abs(F.col("x") - F.col("o")))).first()[0] or 0.0)
        x = new
        if history[-1] < tolerance:
            break
    return x, history


def forward_errors(x: DataFrame, truth: DataFrame) -> DataFrame:
    """(absolute, relative): the largest |x - truth|, also over the largest |truth|."""
    both = x.select("i", "x").join(truth.select("i", F.col("x").alias("t")), "i")
    return both.agg(F.max(F.abs(F.col("x") - F.col("t"))).alias("absolute"), (F.max(F.abs(F.col("x") - F.col("t"))) / F.max(F.abs("t"))).alias("relative"))


def backward_errors(a: DataFrame, b: DataFrame, x: DataFrame) -> DataFrame:
    """(normwise, componentwise): max |r| / (|A| |x| + |b|) in the infinity norm, and the largest |r_i| / (|A| |x| + |b|)_i."""
    ax = matvec(a, x).select("i", F.col("x").alias("ax"))
    size = matvec(a.select("i", "j", F.abs("v").alias("v")), x.select("i", F.abs("x").alias("x"))).select("i", F.col("x").alias("s"))
    rows = a.groupBy("i").agg(F.sum(F.abs("v")).alias("norm"))
    all_ = b.select("i", F.col("x").alias("b")).join(ax, "i").join(size, "i").join(rows, "i")
    r = F.abs(F.col("b") - F.col("ax"))
    bottom = F.max("norm") * x.agg(F.max(F.abs("x"))).scalar() + F.max(F.abs("b"))
    return all_.agg((F.max(r) / bottom).alias("normwise"), F.max(F.when(F.col("s") + F.abs("b") > 0, r / (F.col("s") + F.abs("b"))).otherwise(0.0)).alias("componentwise"))
