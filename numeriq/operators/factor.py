"""Factors of tall matrices: QR with its Q, and singular vectors of sparse matrices by a random sketch, with the checks of both.

Rows stay in tables; what tasks hold is a block of rows or the p x p factors of some blocks, and only p x p numbers come to the driver.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..plans.lineage import cut
from .estimators import gram_sums
from .joins import meet

#: Numbers of a block of rows, and factors that are stacked at once.
BLOCK_NUMBERS, FAN = 1 << 19, 8


def tall_skinny_qr(points: DataFrame, vector_col: str = "v", id_col: str = "id") -> tuple[DataFrame, Any]:
    """(q, r): q (id, q) with orthonormal columns and r upper triangular with a diagonal that isn't negative, so that the vectors are q r.

    A tree: blocks of rows are factored, their R are stacked FAN at a time and factored again, up to one. The Q of every level are kept, and on the way
    down each piece is multiplied by what its parent got. Rows without a vector are left out.
    """
    import numpy as np

    rows = points.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).filter("v IS NOT NULL")
    size, count = rows.agg(F.max(F.size("v")), F.count("*")).first()
    if not count:
        return rows.select("id", F.col("v").alias("q")), np.zeros((0, 0))
    blocks = max(1, -(-count * size // BLOCK_NUMBERS))
    kind = dict(rows.dtypes)["id"]

    def factored(pdf):
        import pandas as pd

        q, r = np.linalg.qr(np.stack(pdf["v"].to_numpy()).astype(np.float64).reshape(-1, size))
        # The first row of a block carries its R.
        return pd.DataFrame({"id": pdf["id"], "block": pdf["block"], "q": list(q), "r": [r.ravel().tolist()] + [None] * (len(pdf) - 1)})

    def stacked(pdf):
        import pandas as pd

        pdf = pdf.sort_values("block")
        parts = [np.asarray(r, np.float64).reshape(-1, size) for r in pdf["r"]]
        q, r = np.linalg.qr(np.vstack(parts))
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return pd.DataFrame({"block": pdf["block"], "parent": pdf["parent"], "q": [p.ravel().tolist() for p in np.split(q, cuts)], "r": [r.ravel().tolist()] + [None] * (len(pdf) - 1)})

    dealt = cut(rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))))
    leaves = cut(dealt.groupBy("block").applyInPandas(factored, f"id {kind}, block long, q array<double>, r array<double>"))
    now, levels = leaves.filter("r IS NOT NULL").select("block", "r"), []
    while not levels or levels[-1].select("parent").distinct().count() > 1:
        level = now.withColumn("parent", F.floor(F.col("block") / FAN))
        levels.append(cut(level.groupBy("parent").applyInPandas(stacked, "block long, parent long, q array<double>, r array<double>")))
        now = levels[-1].filter("r IS NOT NULL").select(F.col("parent").alias("block"), "r")
    r = np.array(now.first()["r"]).reshape(-1, size)
    signs = np.where(np.diag(r) < 0, -1.0, 1.0)

    def product(a, b):
        """Pieces times what their parents got."""
        import pandas as pd

        t = np.asarray(b["t"].iloc[0], np.float64)
        high = int(b["rows"].iloc[0])
        t = t.reshape(high, -1)
        out = [np.asarray(q, np.float64).reshape(-1, high) @ t for q in a["q"]]
        return pd.DataFrame({"block": a["block"], "t": [x.ravel().tolist() for x in out], "rows": [len(x) for x in out]})

    down = points.sparkSession.createDataFrame([(0, np.diag(signs).ravel().tolist(), len(r))], "block long, t array<double>, rows int")
    for level in reversed(levels):
        pieces = level.select("block", "parent", "q")
        down = cut(pieces.groupBy("parent").cogroup(down.withColumnRenamed("block", "parent").groupBy("parent")).applyInPandas(product, "block long, t array<double>, rows int"))

    def finished(a, b):
        import pandas as pd

        t = np.asarray(b["t"].iloc[0], np.float64).reshape(int(b["rows"].iloc[0]), -1)
        return pd.DataFrame({"id": a["id"], "q": list(np.stack(a["q"].to_numpy()).astype(np.float64) @ t)})

    q = leaves.select("id", "block", "q").groupBy("block").cogroup(down.groupBy("block")).applyInPandas(finished, f"id {kind}, q array<double>")
    return q, r * signs[:, None]


def orthogonality_error(q: DataFrame, vector_col: str = "q") -> dict[str, float]:
    """How far Q'Q is from the unit matrix: its largest element and its Frobenius norm."""
    import numpy as np

    off = inner_products(q, vector_col)
    off -= np.eye(len(off))
    return {"largest": float(np.abs(off).max(initial=0)), "frobenius": float(np.linalg.norm(off))}


def inner_products(rows: DataFrame, vector_col: str) -> Any:
    """The p x p matrix of the columns' inner products."""
    return gram_sums(rows, vector_col)[2]


def factor_residual(points: DataFrame, q: DataFrame, r: Any, vector_col: str = "v", id_col: str = "id") -> dict[str, float]:
    """|A - Q R|: the largest element, the Frobenius norm, and that over |A|. Ids are unique."""
    import numpy as np

    both = points.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).join(q.select("id", "q"), "id")

    def left(batches):
        import pandas as pd

        most = off = all_ = 0.0
        for pdf in batches:
            if len(pdf):
                a, b = (np.stack(pdf[c].to_numpy()).astype(np.float64) for c in ("v", "q"))
                d = a - b @ r
                most, off, all_ = max(most, float(np.abs(d).max())), off + float((d * d).sum()), all_ + float((a * a).sum())
        yield pd.DataFrame({"most": [most], "off": [off], "size": [all_]})

    most, off, size = both.mapInPandas(left, "most double, off double, size double").agg(F.max("most"), F.sum("off"), F.sum("size")).first()
    return {"largest": most or 0.0, "frobenius": (off or 0.0) ** 0.5, "relative": ((off or 0.0) / (size or 1.0)) ** 0.5}


def randomized_svd(a: DataFrame, k: int, oversample: int = 8, power: int = 3, seed: int = 3) -> tuple[DataFrame, list[float], DataFrame]:
    """(u, values, v) of a sparse matrix (i, j, v): u (i, u) and v (j, v) are the k leading singular vectors; a vector's element of largest size in v is positive.

    A sketch of random signs, made where they are used by hashing columns, is multiplied by A and its transpose in turn; between products its rows, k + oversample
    numbers each, are made orthonormal by their inner products (at last twice, which leaves rounding only). Rows or columns without entries have no vector.
    """
    import numpy as np

    size = k + oversample

    def sums(df: DataFrame, by: str) -> DataFrame:
        return df.groupBy(by).agg(F.array(*[F.sum(F.col("v") * F.col("y")[c]) for c in range(size)]).alias("y"))

    def turned(y: DataFrame, by: Any, name: str = "y") -> DataFrame:
        return y.withColumn(name, F.array(*[dot(F.col("y"), F.array(*map(F.lit, by[:, c].tolist()))) for c in range(by.shape[1])]))

    def orthonormal(y: DataFrame, times: int = 1) -> DataFrame:
        for _ in range(times):
            y = cut(y)
            values, vectors = np.linalg.eigh(inner_products(y, "y"))
            scale = np.where(values > 1e-14 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
            y = turned(y, vectors * scale)
        return cut(y)

    sign = lambda c: F.pmod(F.xxhash64("j", F.lit(seed), F.lit(c)), F.lit(2)) * 2.0 - 1.0
    y = orthonormal(sums(a.withColumn("y", F.array(*[sign(c) for c in range(size)])), "i"))
    for n in range(power):
        z = orthonormal(sums(meet(a, y, "i", size), "j"))
        y = orthonormal(sums(meet(a, z, "j", size), "i"), 2 if n == power - 1 else 1)
    z = cut(sums(meet(a, y, "i", size), "j"))
    values, vectors = np.linalg.eigh(inner_products(z, "y"))
    order = [c for c in np.argsort(-values)[:k] if values[c] > 1e-20 * max(values.max(), 1e-300)]
    found, turn = np.sqrt(values[order]), vectors[:, order]
    right = turned(z, turn / found, "v").select("j", "v")
    most = right.select("j", F.posexplode("v").alias("c", "x")).groupBy("c").agg(F.max_by("x", F.struct(F.abs("x"), -F.col("j"))).alias("x")).collect()
    signs = np.ones(len(order))
    for c, x in most:
        signs[c] = -1.0 if x < 0 else 1.0
    flip = F.array(*map(F.lit, signs.tolist()))
    u = turned(y, turn * signs, "u").select("i", "u")
    return u, found.tolist(), right.select("j", F.zip_with("v", flip, lambda x, s: x * s).alias("v"))


def reconstruction_error(a: DataFrame, u: DataFrame, values: list[float], v: DataFrame) -> dict[str, float]:
    """|A - U S V'| in the Frobenius norm, and over |A|: from A's entries and the inner products of U and of V, so nothing dense is made."""
    import numpy as np

    s = np.array(values)
    met = meet(meet(a, u, "i", len(values)), v.withColumnRenamed("v", "__v"), "j", len(values), a)
    at = F.aggregate(F.zip_with(F.zip_with("u", "__v", lambda x, y: x * y), F.array(*map(F.lit, values)), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    cross = met.agg(F.sum(F.col("v") * at)).first()[0] or 0.0
    size = a.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
    own = float((np.outer(s, s) * inner_products(u, "u") * inner_products(v, "v")).sum())
    left = max(size - 2 * cross + own, 0.0)
    return {"frobenius": left**0.5, "relative": (left / size) ** 0.5 if size else 0.0}


def projection_error(points: DataFrame, vector_col: str, mean: list[float], components: list[list[float]]) -> DataFrame:
    """(mean_squared, largest): what is lost per row by projecting vectors on components and back."""
    x = F.zip_with(vector_col, F.array(*map(F.lit, mean)), lambda p, m: p.cast("double") - m)
    parts = [F.array(*map(F.lit, c)) for c in components]
    lost = dot(x, x)
    for c in parts:
        lost = lost - dot(x, c) * dot(x, c)
    return points.agg(F.avg(lost).alias("mean_squared"), F.sqrt(F.max(lost)).alias("largest"))
