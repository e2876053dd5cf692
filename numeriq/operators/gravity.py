"""Softened gravity among all pairs of bodies, by a distributed quadtree: far cells as one mass, near ones body by body.

Cells are counted level by level; a cell of at most LEAF bodies, or one of the deepest level, is a leaf. Leaves go down the tree together, a join per
level: a cell whose side is less than `angle` times its distance from the leaf is taken as a mass at its centre, else it is opened, and a leaf that is
opened gives its bodies. At angle 0 no cell would be taken, and every pair is summed without a tree: a block of bodies meets a block of sources in a task.
Equal positions are one source, for they don't pull each other.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Bodies of a leaf, and levels of the tree.
LEAF, DEEPEST = 32, 12
#: Bodies and sources of a block where every pair is summed.
TARGETS, SOURCES = 2048, 16384


def quadtree(sources: DataFrame, leaf: int, deepest: int) -> tuple[DataFrame, tuple[float, float, float]]:
    """(nodes, box): nodes (level, cx, cy, n, m, gx, gy) by level and cell with its centre of gravity; box: the least x and y, and the side of the root."""
    x0, x1, y0, y1 = sources.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    box = (x0, y0, max(x1 - x0, y1 - y0) or 1.0)
    moments = lambda m, x, y: [F.sum(m).alias("m"), F.sum(x).alias("sx"), F.sum(y).alias("sy")]
    m, x, y = map(F.col, "mxy")
    finest = in_cells(sources, box, deepest).groupBy("cx", "cy").agg(F.count("*").alias("n"), *moments(m, m * x, m * y))
    up = lambda c: F.call_function("shiftright", F.col(c), F.lit(deepest) - F.col("level")).alias(c)
    every = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest)))).select("level", up("cx"), up("cy"), "n", "m", "sx", "sy")
    sums = every.groupBy("level", "cx", "cy").agg(F.sum("n").alias("n"), *moments("m", "sx", "sy"))
    nodes = sums.select("level", "cx", "cy", "n", "m", (F.col("sx") / F.col("m")).alias("gx"), (F.col("sy") / F.col("m")).alias("gy"))
    return cut(nodes), box


def in_cells(bodies: DataFrame, box: tuple[float, float, float], depth: int) -> DataFrame:
    x0, y0, side = box
    cell = lambda c, low: F.least(F.lit((1 << depth) - 1), F.floor((F.col(c) - low) / side * (1 << depth)).cast("int"))
    return bodies.withColumns({"cx": cell("x", x0), "cy": cell("y", y0)})


def force(dx: Column, dy: Column, m: Column, softening: float) -> tuple[Column, Column, Column]:
    """(ax, ay, potential) of a mass at (dx, dy)."""
    d2 = dx * dx + dy * dy + softening
    root = F.sqrt(d2)
    return m * dx / (d2 * root), m * dy / (d2 * root), -m / root


def all_pairs(bodies: DataFrame, sources: DataFrame, softening: float, targets: int = TARGETS, held: int = SOURCES) -> DataFrame:
    """(id, ax, ay, potential) of bodies that have a place, from every source. A row is a block of bodies with a block of sources; a task holds one at a time."""

    def blocks(df: DataFrame, key: Column, size: int, name: str, *columns: str) -> DataFrame:
        n = max(1, -(-df.count() // size))
        return cut(df.groupBy(F.pmod(key, F.lit(n)).alias(name)).agg(F.collect_list(F.struct(*columns)).alias(name + "s")).repartition(min(n, 200)))

    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    left = blocks(bodies.filter(known), F.xxhash64("id"), targets, "t", "id", "x", "y")
    right = blocks(sources.filter(known & F.col("m").isNotNull()), F.xxhash64("x", "y"), held, "s", "x", "y", "m")
    names = ["id", "ax", "ay", "potential"]

    def summed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for t, s in zip(b.column(0), b.column(1)):
                t, s = t.values, s.values
                x, y = (t.field(c).to_numpy(zero_copy_only=False)[:, None] for c in "xy")
                sx, sy, m = (s.field(c).to_numpy(zero_copy_only=False)[None] for c in "xym")
                out = np.zeros((3, len(x)))
                step = max(1, 262_144 // m.shape[1])
                for a in range(0, len(x), step):
                    dx, dy = sx - x[a : a + step], sy - y[a : a + step]
                    d2 = dx * dx + dy * dy + softening
                    by_root = m / np.sqrt(d2)
                    pull = by_root / d2
                    by_root[(dx == 0) & (dy == 0)] = 0.0
                    out[:, a : a + step] = (pull * dx).sum(1), (pull * dy).sum(1), -by_root.sum(1)
                yield pa.RecordBatch.from_arrays([t.field("id"), *map(pa.array, out)], names=names)

    pairs = left.crossJoin(right).repartition(max(1, -(-left.count() * right.count() // 4)), "t", "s").select("ts", "ss")
    parts = one_pair_a_batch(pairs).mapInArrow(summed, f"id {dict(bodies.dtypes)['id']}, ax double, ay double, potential double")
    return parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in names[1:]])


def one_pair_a_batch(pairs: DataFrame, most: int = 16 << 20) -> DataFrame:
    """Blocks are long rows: a worker gets a bounded number of bytes at once. The setting stays with the session; a smaller one is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(pairs.sparkSession.conf.get(name).removesuffix("b")) <= most:
        pairs.sparkSession.conf.set(name, str(most))
    return pairs


def gravity(bodies: DataFrame, angle: float = 0.5, softening: float = 1e-3, leaf: int | None = None, deepest: int | None = None) -> DataFrame:
    """(id, ax, ay, potential) of bodies (id, x, y, m): the pull of all others. potential leaves out the body itself and those at its own place."""
    leaf, deepest = leaf or LEAF, DEEPEST if deepest is None else deepest
    bodies = cut(bodies.select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "m")]))
    sources = cut(bodies.groupBy("x", "y").agg(F.sum("m").alias("m")))
    if sources.isEmpty():
        return bodies.select("id", *[F.lit(0.0).alias(c) for c in ("ax", "ay", "potential")])
    if angle <= 0:
        return in_rows(bodies, all_pairs(bodies, sources, softening))
    nodes, box = quadtree(sources, leaf, deepest)
    x0, y0, side = box
    is_leaf = (F.col("n") <= leaf) | (F.col("level") == deepest)
    # The shallowest cell that is a leaf, for each cell of the deepest level.
    finest = nodes.filter(F.col("level") == deepest).select(F.col("cx").alias("fx"), F.col("cy").alias("fy"), F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("level"))
    up = lambda c: F.call_function("shiftright", F.col(c), F.lit(deepest) - F.col("level")).alias("c" + c[1])
    met = finest.select("fx", "fy", "level", up("fx"), up("fy")).join(nodes.filter(is_leaf).select("level", "cx", "cy"), ["level", "cx", "cy"])
    leaves = cut(met.groupBy("fx", "fy").agg(F.min(F.struct("level", "cx", "cy")).alias("t")).select(F.col("fx").alias("cx"), F.col("fy").alias("cy"), F.col("t").alias("leaf")))
    placed = lambda df: in_cells(df, box, deepest).join(leaves, ["cx", "cy"]).drop("cx", "cy")
    targets, sources = cut(placed(bodies)), cut(placed(sources))

    front = leaves.select("leaf").distinct().select("leaf", F.lit(0).alias("level"), F.lit(0).alias("cx"), F.lit(0).alias("cy"))
    far, near = [], []
    for depth in range(deepest + 1):
        met = cut(front.hint("merge").join(nodes.filter(F.col("level") == depth), ["level", "cx", "cy"]))
        size = side / (1 << depth)
        tside = F.lit(side) / F.call_function("shiftleft", F.lit(1).cast("long"), F.col("leaf.level"))
        gap = lambda c, low, g: F.greatest(F.lit(low) + F.col(f"leaf.{c}") * tside - F.col(g), F.col(g) - F.lit(low) - (F.col(f"leaf.{c}") + 1) * tside, F.lit(0.0))  # noqa: B023, E731
        away = F.hypot(gap("cx", x0, "gx"), gap("cy", y0, "gy"))
        # The mass may lie in a corner of its cell: its diagonal is what counts, and a leaf never takes itself as a mass.
        accepted = (F.lit(size * 2**0.5) < angle * away) & (away > 0)
        far.append(met.filter(accepted).select("leaf", "m", "gx", "gy"))
        opened = met.filter(~accepted)
        near.append(opened.filter(is_leaf).select("leaf", F.struct("level", "cx", "cy").alias("source")))
        inner = opened.filter(~is_leaf)
        if depth == deepest or inner.isEmpty():
            break
        child = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("k")
        front = inner.select("leaf", (F.col("level") + 1).alias("level"), "cx", "cy", child).select("leaf", "level", (F.col("cx") * 2 + F.col("k.a")).alias("cx"), (F.col("cy") * 2 + F.col("k.b")).alias("cy"))
    all_far, all_near = far[0], near[0]
    for f, n in zip(far[1:], near[1:]):
        all_far, all_near = all_far.unionByName(f), all_near.unionByName(n)
    masses = all_far.select("leaf", F.col("gx").alias("sx"), F.col("gy").alias("sy"), F.col("m").alias("sm"))
    # Tables of cells are small as files and large as rows: none is broadcast.
    points = all_near.hint("merge").join(sources.select(F.col("leaf").alias("source"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("m").alias("sm")), "source").drop("source")
    pairs = targets.join(masses.unionByName(points.select("leaf", "sx", "sy", "sm")), "leaf").filter((F.col("sx") != F.col("x")) | (F.col("sy") != F.col("y")))
    parts = force(F.col("sx") - F.col("x"), F.col("sy") - F.col("y"), F.col("sm"), softening)
    sums = pairs.groupBy("id").agg(*[F.sum(p).alias(c) for p, c in zip(parts, ("ax", "ay", "potential"))])
    return in_rows(bodies, sums)


def in_rows(bodies: DataFrame, sums: DataFrame) -> DataFrame:
    return bodies.select("id").join(sums, "id", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ax", "ay", "potential")])


def move(bodies: DataFrame, dt: float, steps: int, angle: float = 0.5, softening: float = 1e-3, constant: float = 1.0) -> DataFrame:
    """bodies (id, x, y, vx, vy, m) after so many leapfrog steps: half a kick, a drift, half a kick, so that the energy doesn't drift away."""
    pulled = lambda b: b.join(gravity(b, angle, softening), "id")
    kick = lambda b, h: b.withColumns({"vx": F.col("vx") + h * constant * F.col("ax"), "vy": F.col("vy") + h * constant * F.col("ay")})
    now = cut(pulled(bodies))
    for _ in range(steps):
        half = kick(now, dt / 2).drop("ax", "ay", "potential")
        drifted = cut(half.withColumns({"x": F.col("x") + dt * F.col("vx"), "y": F.col("y") + dt * F.col("vy")}))
        now = cut(kick(pulled(drifted), dt / 2))
    return now.select("id", "x", "y", "vx", "vy", "m")


def energy(bodies: DataFrame, angle: float = 0.0, softening: float = 1e-3, constant: float = 1.0) -> DataFrame:
    """(kinetic, potential) of bodies; bodies at one place have no potential between them."""
    b = bodies.join(gravity(bodies, angle, softening), "id")
    kinetic = F.sum(0.5 * F.col("m") * (F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))
    return b.agg(kinetic.alias("kinetic"), (F.sum(F.col("m") * F.col("potential")) * 0.5 * constant).alias("potential"))
