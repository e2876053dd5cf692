"""Interpolation and ordinary differential equations per series, and steps of grid and body models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .joins import asof_lookup, stencil
from .sequences import prolong, restrict


def lagrange(nodes: DataFrame, by: list[str], x: str, y: str, at: float) -> DataFrame:
    """(by, value) of the polynomial through a series' few nodes, as an array expression per series."""
    points = nodes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    at_ = F.lit(float(at))
    term = lambda a: F.aggregate(F.filter("p", lambda b: b["x"] != a["x"]), a["y"], lambda s, b: s * (at_ - b["x"]) / (a["x"] - b["x"]))
    return points.select(*by, F.aggregate(F.transform("p", term), F.lit(0.0), lambda s, t: s + t).alias("value"))


def spline_second_derivatives(knots: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Knots (by, x, y, m) with the second derivatives of the natural cubic spline; one tridiagonal solve per series, in its task."""

    def solve(pdf):
        import numpy as np

        pdf = pdf.drop_duplicates(x).sort_values(x)
        xs, ys, n = pdf[x].to_numpy(float), pdf[y].to_numpy(float), len(pdf)
        m = np.zeros(n)
        if n > 2:
            h = np.diff(xs)
            rhs = 6 * (np.diff(ys)[1:] / h[1:] - np.diff(ys)[:-1] / h[:-1])
            low, mid, up = h[1:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:-1].copy()
            for k in range(1, n - 2):  # forward elimination, then back substitution
                f = low[k - 1] / mid[k - 1]
                mid[k] -= f * up[k - 1]
                rhs[k] -= f * rhs[k - 1]
            m[n - 2] = rhs[-1] / mid[-1]
            for k in range(n - 4, -1, -1):
                m[k + 1] = (rhs[k] - up[k] * m[k + 2]) / mid[k]
        return pdf.assign(m=m)[[*by, x, y, "m"]]

    types = dict(knots.dtypes)
    rows = knots.select(*by, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    return rows.groupBy(*by).applyInPandas(solve, ", ".join(f"{c} {types[c]}" for c in by) + f", {x} double, {y} double, m double")


def spline_value(t, x0, x1, y0, y1, m0, m1) -> Column:
    h = x1 - x0
    a, b = (x1 - t) / h, (t - x0) / h
    return a * y0 + b * y1 + ((a * a * a - a) * m0 + (b * b * b - b) * m1) * h * h / 6


def spline_at(knots: DataFrame, points: DataFrame, by: list[str], x: str, y: str, t: str) -> DataFrame:
    """points with value, the natural cubic spline of their series at t: each point looks its interval up among the knots. t at the last knot takes the last
    interval; beyond the knots, or where a series has a single knot, the value is null."""
    w = Window.partitionBy(*by).orderBy(x)
    ends = [F.lead(c).over(w).alias(c + "1") for c in (x, y, "m")]
    last = F.max(x).over(Window.partitionBy(*by))
    known = spline_second_derivatives(knots, by, x, y).select(*by, x, y, "m", *ends, last.alias("__last")).filter(F.col(x + "1").isNotNull())
    steps = known.select(F.struct(*by).alias("__by"), F.col(x).alias("__at"), F.struct(x, y, "m", x + "1", y + "1", "m1", "__last").alias("__s"))
    asked = points.withColumn("__by", F.struct(*by)).withColumn("__at", F.col(t).cast("double"))
    met = asof_lookup(asked, steps, "__by", "__at", "__s")
    s = lambda c: F.col("__s." + c)
    inside = F.when(F.col("__at") <= s("__last"), spline_value(F.col("__at"), s(x), s(x + "1"), s(y), s(y + "1"), s("m"), s("m1")))
    return met.withColumn("value", inside).drop("__by", "__at", "__s")


def chain_derivative(y) -> Column:
    """y_i' = y_{i-1} - 2 y_i + y_{i+1}, with zeros beyond both ends."""
    n = F.size(y)
    return F.transform(y, lambda v, i: F.when(i > 0, F.get(y, i - 1)).otherwise(0.0) - 2 * v + F.when(i < n - 1, F.get(y, i + 1)).otherwise(0.0))


def _plus(y, k, h) -> Column:
    return F.zip_with(y, k, lambda a, b: a + h * b)


def rk4(y0, h: float, steps: int) -> Column:
    """The state after so many steps of the classical Runge-Kutta method; each step is one element of a fold."""

    def step(y):
        k1 = chain_derivative(y)
        k2 = chain_derivative(_plus(y, k1, h / 2))
        k3 = chain_derivative(_plus(y, k2, h / 2))
        k4 = chain_derivative(_plus(y, k3, h))
        slopes = F.zip_with(F.zip_with(k1, k4, lambda a, b: a + b), F.zip_with(k2, k3, lambda a, b: a + b), lambda a, b: (a + 2 * b) / 6)
        return _plus(y, slopes, h)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), y0, lambda y, _: step(y))


def trapezoid(y0, h: float, steps: int, fixed_points: int = 5) -> Column:
    """The implicit trapezoidal rule, each step solved by fixed-point iterations."""

    def step(y):
        k = chain_derivative(y)
        closer = lambda new, _: _plus(y, F.zip_with(k, chain_derivative(new), lambda a, b: a + b), h / 2)
        return F.aggregate(F.sequence(F.lit(1), F.lit(fixed_points)), _plus(y, k, h), closer)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), y0, lambda y, _: step(y))


def heat_step(grid: DataFrame, power: str, v: str = "v", rate: float = 0.1, ambient: float = 80.0, pull: float = 0.01) -> DataFrame:
    """A step of a plate's temperature: a stencil of neighbours, a source, and loss to the surroundings."""
    g = stencil(grid, v=v)
    own = F.col(v)
    new = own + rate * (F.col("n") + F.col("s") + F.col("w") + F.col("e") - 4 * own) + F.col(power) + pull * (ambient - own)
    return g.withColumn(v, new).drop("n", "s", "w", "e")


def diffusion_step(grid: DataFrame, v: str = "v", rate: float = 0.5) -> DataFrame:
    """A step of speckle-reducing diffusion: coefficients fall where a cell differs from its neighbours more than the whole does."""
    q0 = grid.agg((F.var_pop(v) / F.pow(F.avg(v), 2.0))).scalar()
    g = stencil(grid, v=v).withColumn("q0", q0)
    own = F.col(v)
    d = {k: F.col(k) - own for k in "nswe"}
    g2 = (d["n"] * d["n"] + d["s"] * d["s"] + d["w"] * d["w"] + d["e"] * d["e"]) / (own * own)
    lap = (d["n"] + d["s"] + d["w"] + d["e"]) / own
    qs = (0.5 * g2 - lap * lap / 16) / F.pow(1 + 0.25 * lap, 2.0)
    c = 1 / (1 + (qs - F.col("q0")) / (F.col("q0") * (1 + F.col("q0"))))
    g = g.select("r", "c", v, "n", "s", "w", "e", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).alias("k"))
    near = stencil(g.select("r", "c", "k"), v="k").select("r", "c", F.col("s").alias("ks"), F.col("e").alias("ke"))
    g = g.join(near, ["r", "c"])
    flow = F.col("ks") * (F.col("s") - own) + F.col("k") * (F.col("n") - own) + F.col("ke") * (F.col("e") - own) + F.col("k") * (F.col("w") - own)
    return g.select("r", "c", (own + rate / 4 * flow).alias(v))


def attraction(bodies: DataFrame, group: str, x: str, y: str, mass: str, softening: float = 1e-3) -> DataFrame:
    """bodies with ax, ay: softened gravity of the groups' centres of mass, a body's own group excluded.

    Groups (bounded in number) are one array; no pairs of bodies are formed.
    """
    cells = bodies.groupBy(group).agg(F.sum(mass).alias("m"), (F.sum(F.col(mass) * F.col(x)) / F.sum(mass)).alias("x"), (F.sum(F.col(mass) * F.col(y)) / F.sum(mass)).alias("y"))
    table = cells.agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "m", "x", "y")))).scalar()
    b = bodies.withColumn("__cells", table)

    def pull(axis):
        def one(c):
            dx, dy = c["x"] - F.col(x), c["y"] - F.col(y)
            d2 = dx * dx + dy * dy + softening
            return F.when(c["g"] == F.col(group), 0.0).otherwise(c["m"] * (dx if axis == "x" else dy) / (d2 * F.sqrt(d2)))

        return F.aggregate(F.transform("__cells", one), F.lit(0.0), lambda s, v: s + v)

    return b.withColumns({"ax": pull("x"), "ay": pull("y")}).drop("__cells")


def simpson(y0, h: float, steps: int, fixed_points: int = 5) -> Column:
    """Simpson's two-step rule: each step advances by 2 h, from a first guess that fixed-point iterations improve."""

    def step(y):
        k = chain_derivative(y)
        middle = chain_derivative(_plus(y, k, h))
        known = F.zip_with(k, middle, lambda a, b: a + 4 * b)
        closer = lambda new, _: _plus(y, F.zip_with(known, chain_derivative(new), lambda a, b: a + b), h / 3)
        return F.aggregate(F.sequence(F.lit(1), F.lit(fixed_points)), _plus(y, k, 2 * h), closer)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), y0, lambda y, _: step(y))


def laplacian(grid: DataFrame) -> DataFrame:
    """(r, c, v) of 4 v - its neighbours, cells outside counting as 0: each cell is sent to its neighbours and sums are taken."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("k")) for a, b, k in ((0, 0, 4.0), (1, 0, -1.0), (-1, 0, -1.0), (0, 1, -1.0), (0, -1, -1.0))])).alias("m")
    sent = grid.select("r", "c", "v", moves).select((F.col("r") + F.col("m.a")).alias("r"), (F.col("c") + F.col("m.b")).alias("c"), (F.col("v") * F.col("m.k")).alias("v"))
    return sent.join(grid.select("r", "c"), ["r", "c"], "left_semi").groupBy("r", "c").agg(F.sum("v").alias("v"))


def smooth(u: DataFrame, f: DataFrame, sweeps: int = 2, damping: float = 0.8) -> DataFrame:
    """Damped Jacobi sweeps for the five-point Laplacian."""
    for _ in range(sweeps):
        r = residual(u, f)
        u = cut(u.join(r.select("r", "c", F.col("v").alias("d")), ["r", "c"]).select("r", "c", (F.col("v") + damping / 4 * F.col("d")).alias("v")))
    return u


def residual(u: DataFrame, f: DataFrame) -> DataFrame:
    return f.select("r", "c", F.col("v").alias("f")).join(laplacian(u), ["r", "c"]).select("r", "c", (F.col("f") - F.col("v")).alias("v"))


def v_cycle(u: DataFrame, f: DataFrame, levels: int = 2) -> DataFrame:
    """One multigrid cycle on full grids: smooth, solve for the residual on the grid of half the size, add its prolongation, smooth."""
    u = smooth(u, f)
    if levels > 1:
        coarse = cut(restrict(residual(u, f)).withColumn("v", F.col("v") * 4))
        e = v_cycle(coarse.withColumn("v", F.lit(0.0)), coarse, levels - 1)
        fine = prolong(e).select("r", "c", F.col("v").alias("e"))
        u = cut(u.join(fine, ["r", "c"], "left").select("r", "c", (F.col("v") + F.coalesce("e", F.lit(0.0))).alias("v")))
    return smooth(u, f)
