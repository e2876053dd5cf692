"""Incomplete LU of sparse matrices without fill, by colours.

Rows that share no entry get one colour, and rows are eliminated colour by colour: within a colour all at once, so that factoring takes a join per colour, and
so do the two triangular solves of an application. The order of elimination is that of (colour, row); the factor has the pattern of the matrix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def coloured(a: DataFrame) -> DataFrame:
    """(i, colour) of the rows of a matrix (i, j, v): no two rows with an entry between them, either way, have one colour.

    In each round the rows whose hash beats those of all their uncoloured neighbours take the least colour that no neighbour has.
    """
    links = a.filter("i <> j").select("i", "j")
    links = cut(links.unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    state = cut(a.select("i").unionByName(a.select(F.col("j").alias("i"))).distinct().withColumn("colour", F.lit(None).cast("int")))
    while not state.filter("colour IS NULL").isEmpty():
        rank = F.struct(F.xxhash64("i"), "i")
        near = state.select(F.col("i").alias("j"), rank.alias("theirs"), F.col("colour").alias("taken"))
        open_ = state.filter("colour IS NULL").select("i", rank.alias("mine"))
        met = open_.join(links, "i", "left").join(near, "j", "left").groupBy("i").agg(
            F.coalesce(F.bool_and(F.col("taken").isNotNull() | (F.col("theirs") < F.col("mine"))), F.lit(True)).alias("wins"), F.collect_set("taken").alias("used"))
        least = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used"))
        state = cut(state.filter("colour IS NOT NULL").unionByName(met.select("i", F.when(F.col("wins"), least).alias("colour"))))
    return state


def incomplete_lu(a: DataFrame, colours: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(factor, colours, n): factor (i, j, v, ci, cj) holds L below the diagonal (its own is 1) and U on and above it, in the order of colours ci, cj.

    colours (i, colour from 0): where a colouring is known, such as the two of a grid, it saves the search and joins for more colours.
    """
    if colours is None:
        colours = coloured(a)
    else:
        colours = cut(colours.select("i", F.col("colour").cast("int").alias("colour")))
        near = colours.select(F.col("i").alias("j"), F.col("colour").alias("theirs"))
        if not a.filter("i <> j").join(colours, "i", "left").join(near, "j", "left").filter("coalesce(colour = theirs, true)").isEmpty():
            raise ValueError("rows with an entry between them have one colour, or none")
    n = (colours.agg(F.max("colour")).first()[0] or 0) + 1
    of = lambda c: colours.select(F.col("i").alias(c), F.col("colour").alias("c" + c))
    t = cut(a.groupBy("i", "j").agg(F.sum("v").alias("v")).join(of("i"), "i").join(of("j"), "j"))
    if t.filter("i = j AND v <> 0").count() < colours.count():
        raise ValueError("a row has no diagonal element")
    for c in range(n - 1):
        pivots = t.filter((F.col("ci") == c) & (F.col("i") == F.col("j"))).select("j", F.col("v").alias("d"))
        lower = t.filter((F.col("cj") == c) & (F.col("ci") > c)).join(pivots, "j").select("i", F.col("j").alias("k"), (F.col("v") / F.col("d")).alias("l"))
        upper = t.filter((F.col("ci") == c) & (F.col("cj") > c)).select(F.col("i").alias("k"), "j", F.col("v").alias("u"))
        less = lower.join(upper, "k").groupBy("i", "j").agg(F.sum(F.col("l") * F.col("u")).alias("less"))
        new = t.join(less, ["i", "j"], "left").join(lower.withColumnRenamed("k", "j"), ["i", "j"], "left")
        t = cut(new.select("i", "j", F.coalesce("l", F.col("v") - F.coalesce("less", F.lit(0.0))).alias("v"), "ci", "cj"))
    return t, colours, n


def lu_solver(a: DataFrame, colours: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """r (i, x) -> (L U)^-1 r, for gmres: 2 (n - 1) joins for n colours, stored after every other one."""
    t, colours, n = incomplete_lu(a, colours)
    diagonal = cut(t.filter("i = j").select("i", F.col("v").alias("d")))
    off = cut(t.filter("i <> j"))

    def solve(r: DataFrame) -> DataFrame:
        r = r.join(colours, "i")
        done = r.filter("colour = 0").select("i", "x")
        for c in range(1, n):
            s = off.filter((F.col("ci") == c) & (F.col("cj") < c)).join(done.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("s"))
            here = r.filter(F.col("colour") == c).join(s, "i", "left").select("i", (F.col("x") - F.coalesce("s", F.lit(0.0))).alias("x"))
            done = done.unionByName(here)
            done = done if c % 2 and c < n - 1 else cut(done)
        y = done.join(diagonal, "i").join(colours, "i")
        done = y.filter(F.col("colour") == n - 1).select("i", (F.col("x") / F.col("d")).alias("x"))
        for c in range(n - 2, -1, -1):
            s = off.filter((F.col("ci") == c) & (F.col("cj") > c)).join(done.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("s"))
            here = y.filter(F.col("colour") == c).join(s, "i", "left").select("i", ((F.col("x") - F.coalesce("s", F.lit(0.0))) / F.col("d")).alias("x"))
            done = done.unionByName(here)
            done = cut(done) if c and c % 2 == n % 2 else done
        return done

    return solve


def lu_factors(a: DataFrame, colours: DataFrame | None = None) -> list[DataFrame]:
    """Matrices (i, j, v) whose product, the first one first, is (L U)^-1: for n colours 2 (n - 1), or one.

    A colour's rows of L are taken off in one step, I - L_c. With U = (I + N) D for the diagonal D, so are those of N = U D^-1, and the last step divides by D.
    """
    t, _, n = incomplete_lu(a, colours)
    d = cut(t.filter("i = j").select("i", F.col("v").alias("d")))
    one = d.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    upper = t.filter("ci < cj").join(d.withColumnsRenamed({"i": "j"}), "j").select("i", "j", (F.col("v") / F.col("d")).alias("v"), "ci")
    steps = [one.unionByName(t.filter(f"ci = {c} AND cj < {c}").select("i", "j", (-F.col("v")).alias("v"))) for c in range(1, n)]
    steps += [one.unionByName(upper.filter(f"ci = {c}").select("i", "j", (-F.col("v")).alias("v"))) for c in range(n - 2, -1, -1)]
    last = (steps.pop() if n > 1 else one).join(d, "i").select("i", "j", (F.col("v") / F.col("d")).alias("v"))
    return [*steps, last]


def two_colours(a: DataFrame, colours: DataFrame) -> tuple[DataFrame, ...]:
    """Matrices (i, j, v) by which a system whose rows have two colours, preconditioned by its incomplete LU, is iterated on the unknowns of colour 1 alone.

    With A = (D E; F G) and U's diagonal (D, H): own = D^-1, of colour 0; condensed = H^-1 (-F D^-1, 1); spread out = (-D^-1 E; 1); back = H^-1 (F, G). Of r with
    no residual in colour 0, (L U)^-1 r is v = spread out (condensed r), and (L U)^-1 A v is spread out (back v): what lies in colour 0 follows from colour 1. A
    residual there is taken off by own, and condensed allows for it.
    """
    t, _, n = incomplete_lu(a, colours)
    if n > 2:
        raise ValueError("more than two colours")
    d = cut(t.filter("i = j").select("i", F.col("v").alias("d"), "ci"))
    zero, one = d.filter("ci = 0"), d.filter("ci = 1")
    diagonal = one.join(a.filter("i = j").groupBy("i").agg(F.sum("v").alias("v")), "i")
    low = cut(t.filter("ci = 1 AND cj = 0").select("i", "j", "v").join(one.select("i", "d"), "i"))
    at = lambda df, v: df.select("i", F.col("i").alias("j"), v.alias("v"))
    own = at(zero, 1 / F.col("d"))
    condensed = low.select("i", "j", (-F.col("v") / F.col("d")).alias("v")).unionByName(at(one, 1 / F.col("d")))
    out = t.filter("ci = 0 AND cj = 1").select("i", "j", "v").join(zero.select("i", "d"), "i").select("i", "j", (-F.col("v") / F.col("d")).alias("v")).unionByName(at(one, F.lit(1.0)))
    back = low.join(zero.select(F.col("i").alias("j"), F.col("d").alias("e")), "j").select("i", "j", (F.col("v") * F.col("e") / F.col("d")).alias("v")).unionByName(at(diagonal, F.col("v") / F.col("d")))
    return own, condensed, out, back


def growth_factor(a: DataFrame) -> float:
    """How much larger the largest element of the incomplete factor is than that of the matrix."""
    t, _, _ = incomplete_lu(a)
    return t.filter("ci < cj OR i = j").agg(F.max(F.abs("v"))).first()[0] / a.agg(F.max(F.abs("v"))).first()[0]


def one_norm(a: DataFrame) -> float:
    """The largest column sum of absolute values."""
    return a.groupBy("j").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s")).first()[0] or 0.0


def condition_estimate(a: DataFrame, solve: Callable, solve_transposed: Callable, steps: int = 5) -> float:
    """The one-norm condition number, from below: |A| times an estimate of |A^-1| by solves with A and its transpose, climbing from the mean vector to the
    unit vector that grows most. solve(b): x with A x = b."""
    rows = cut(a.select("i").distinct())
    n = rows.count()
    x, best, seen = rows.select("i", F.lit(1.0 / n).alias("x")), 0.0, None
    for _ in range(steps):
        y = cut(solve(x))
        size = y.agg(F.sum(F.abs("x"))).first()[0]
        if size <= best:
            break
        best = size
        z = cut(solve_transposed(y.select("i", F.when(F.col("x") < 0, -1.0).otherwise(1.0).alias("x"))))
        top = z.select(F.max_by("i", F.struct(F.abs("x"), -F.col("i"))).alias("i")).first()["i"]
        if top == seen:
            break
        seen = top
        x = rows.select("i", F.when(F.col("i") == top, 1.0).otherwise(0.0).alias("x"))
    return best * one_norm(a)


def prescribed_condition(spark, n: int, condition: float, reflections: int = 2, seed: int = 5) -> DataFrame:
    """A full matrix (i, j, v) whose singular values fall geometrically from 1 to 1 / condition: a diagonal between products of Householder reflections.

    A reflection is a rank-one update, A - 2 u (u'A): one sum by column and one join, of vectors made by hashing their places. It has n^2 elements.
    """
    index = spark.range(n)
    grid = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"))
    a = index.select(F.col("id").alias("i"), F.col("id").alias("j"), F.pow(F.lit(float(condition)), -F.col("id") / F.lit(float(max(1, n - 1)))).alias("v"))
    unit = lambda salt: cut(index.select(F.col("id").alias("i"), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(20001)) / 10000.0 - 1.0).alias("x")))
    for salt in range(2 * reflections):
        u = unit(salt)
        size = u.agg(F.sum(F.col("x") * F.col("x"))).first()[0]
        side, other = ("i", "j") if salt % 2 == 0 else ("j", "i")
        left, right = u.select(F.col("i").alias(side), F.col("x").alias("p")), u.select(F.col("i").alias(side), F.col("x").alias("q"))
        sums = a.join(left, side).groupBy(other).agg(F.sum(F.col("v") * F.col("p")).alias("s"))
        # Every element of the matrix gets its part of the outer product: two joins by row and column.
        full = a if salt else grid.join(a, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))
        a = cut(full.join(sums, other).join(right, side).select("i", "j", (F.col("v") - 2.0 / size * F.col("s") * F.col("q")).alias("v")))
    return a
