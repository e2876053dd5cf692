"""Steps on meshes: a stencil in three dimensions that exchanges borders once for several steps, and the flow of a gas over elements and their faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pressure, speed_of_sound, speed_squared
from ..plans.lineage import cut


def heat_steps_3d(grid: DataFrame, steps: int, rates: tuple[float, float, float] = (0.1, 0.1, 0.05), source: float = 0.01, pull: float = 0.005, ambient: float = 80.0, side: int = 32) -> DataFrame:
    """(x, y, z, v) after so many steps of v' = v + sum of rate * (neighbour - v) over six neighbours + source * power + pull * (ambient - v).

    grid: x, y, z, v, power, one row a cell; where there is no neighbour the cell is its own. Cells go to their block of side^3 and, up to `steps` cells from a
    border, to the blocks beyond it, so a block has all that its own cells depend on, and the steps cost one shuffle. What is wrong at the rim of a
    block's borders moves inwards by a cell a step and never reaches its own cells.
    """

    def blocks(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - steps) / side), F.floor((F.col(c) + steps) / side))

    sent = grid.select("x", "y", "z", F.col("v").cast("double").alias("v"), F.col("power").cast("double").alias("power"))
    for c in "xyz":
        sent = sent.withColumn("b" + c, F.explode(blocks(c)))

    def stepped(key, pdf):
        import numpy as np
        import pandas as pd

        low = [b * side - steps for b in key]
        wide = side + 2 * steps
        at = tuple(pdf[c].to_numpy() - a for c, a in zip("xyz", low))
        v, power = np.full((wide,) * 3, np.nan), np.zeros((wide,) * 3)
        v[at], power[at] = pdf["v"], pdf["power"]
        for _ in range(steps):
            padded = np.pad(v, 1, constant_values=np.nan)
            new = v + source * power + pull * (ambient - v)
            for axis, rate in enumerate(rates):
                for way in (0, 2):
                    index = [slice(1, -1)] * 3
                    index[axis] = slice(way, way + wide)
                    near = padded[tuple(index)]
                    new = new + rate * np.where(np.isnan(near), 0.0, near - v)
            v = new
        own = np.all([(p >= steps) & (p < steps + side) for p in at], 0)
        inner = tuple(p[own] for p in at)
        return pd.DataFrame({c: p + a for c, p, a in zip("xyz", inner, low)} | {"v": v[inner]})

    return sent.groupBy("bx", "by", "bz").applyInPandas(stepped, "x long, y long, z long, v double")


STATE = ("density", "mx", "my", "mz", "energy")


def contributions(s) -> dict[str, tuple[Column, Column, Column]]:
    """The flux of each variable along x, y and z in a state: a function from names of STATE to columns."""
    velocity = [s(m) / s("density") for m in ("mx", "my", "mz")]
    p = pressure(s("density"), s("energy"), speed_squared(*velocity))
    out = {"density": tuple(s(m) for m in ("mx", "my", "mz")), "energy": tuple(v * (s("energy") + p) for v in velocity)}
    for k, m in enumerate(("mx", "my", "mz")):
        out[m] = tuple(velocity[a] * s(m) + (p if a == k else 0.0) for a in range(3))
    return out


def speeds(s) -> tuple[Column, Column, Column]:
    """(speed, speed of sound, pressure)."""
    v2 = speed_squared(*[s(m) / s("density") for m in ("mx", "my", "mz")])
    p = pressure(s("density"), s("energy"), v2)
    return F.sqrt(v2), speed_of_sound(s("density"), p), p


def step_factor() -> Column:
    """Half over the root of the area times the speed and that of sound, the largest steady step of an element over its area."""
    speed, sound, _ = speeds(F.col)
    return 0.5 / (F.sqrt("area") * (speed + sound))


def step_factors(elements: DataFrame) -> DataFrame:
    """(i, factor)."""
    return elements.select("i", step_factor().alias("factor"))


def flow_fluxes(elements: DataFrame, faces: DataFrame, far: dict[str, float], smoothing: float = 0.2) -> DataFrame:
    """i and the flux of each variable into it over its faces (i, neighbour, nx, ny, nz).

    neighbour is an element; -1 a wall, which gives its pressure; -2, or an element that isn't there, the far field's state. Each face that may have a
    neighbour fetches its state by one join, goes to its own element with it, and meets that one's state and is added up there. Walls and far fields skip the
    first join, in which each would be one key; the states are dealt by element once for both joins.
    """
    own = elements.filter("i is not null").select("i", *STATE)
    # Told apart by a column of their own: a condition on the join's key would be put on its other side too, which then couldn't be shared.
    other = F.when(~F.col("neighbour").isin(-1, -2), F.col("neighbour")).alias("other")
    sides = faces.select("i", other, (F.col("neighbour") == -1).alias("wall"), "nx", "ny", "nz")
    near = sides.filter("other is not null").alias("f").join(own.alias("n"), F.col("f.other") == F.col("n.i"), "left")
    near = near.select("f.i", "wall", "nx", "ny", "nz", *[F.col("n." + c).alias("n_" + c) for c in STATE])
    met = near.unionByName(sides.filter("other is null").select("i", "wall", "nx", "ny", "nz", *[F.lit(None).cast("double").alias("n_" + c) for c in STATE])).join(own, "i")
    normal = [F.col(c) for c in ("nx", "ny", "nz")]
    here, there, beyond = F.col, lambda c: F.col("n_" + c), lambda c: F.lit(float(far[c]))
    (speed, sound, p), (speed_n, sound_n, _) = speeds(here), speeds(there)
    viscous = -F.sqrt(speed_squared(*normal)) * smoothing * 0.5 * (speed + speed_n + sound + sound_n)
    mine, theirs, outside = contributions(here), contributions(there), contributions(beyond)
    wall, known = F.col("wall"), F.col("n_density").isNotNull()
    out = []
    for c in STATE:
        through = lambda other: sum((0.5 * normal[a] * (other[c][a] + mine[c][a]) for a in range(3)), F.lit(0.0))  # noqa: B023, E731
        at_wall = {"mx": normal[0], "my": normal[1], "mz": normal[2]}.get(c)
        flux = F.when(wall, at_wall * p if at_wall is not None else F.lit(0.0)).when(known, viscous * (here(c) - there(c)) + through(theirs)).otherwise(through(outside))
        out.append(F.sum(flux).alias("f_" + c))
    return met.groupBy("i").agg(*out)


def flow_step(elements: DataFrame, faces: DataFrame, far: dict[str, float], stages: int = 3, smoothing: float = 0.2) -> DataFrame:
    """elements (i, density, mx, my, mz, energy, area) after one step: stages of a Runge-Kutta scheme, in which stage s adds the fluxes of the state so far, times
    factor / (stages - s), to the state before the step. Elements without faces stay."""
    before = cut(elements.filter("i is not null").select("i", *[F.col(c).alias("o_" + c) for c in STATE], "area", step_factor().alias("factor")))
    now = elements
    for stage in range(stages):
        fluxes = flow_fluxes(now, faces, far, smoothing)
        share = F.col("factor") / float(stages - stage)
        new = [(F.col("o_" + c) + share * F.coalesce("f_" + c, F.lit(0.0))).alias(c) for c in STATE]
        now = cut(before.join(fluxes, "i", "left").select("i", *new, *["area"] * (stage == stages - 1)))
    return now


def far_state(mach: float = 1.2, angle: float = 0.0) -> dict[str, float]:
    """The state far away for a Mach number and an angle of attack in degrees, density 1.4 and pressure 1."""
    import math

    density, p = 1.4, 1.0
    speed = mach * math.sqrt(1.4 * p / density)
    x, y = speed * math.cos(math.radians(angle)), speed * math.sin(math.radians(angle))
    return {"density": density, "mx": density * x, "my": density * y, "mz": 0.0, "energy": density * 0.5 * speed * speed + p / 0.4}
