"""Weighted k-median by facility location: open centres at a cost each, search for better ones, and search the cost that gives the wanted number.

The cost of points is weight times squared distance to the nearest centre. Each pass over the points is one aggregate: a task sums its points into a small
array, and arrays are added by a shuffle of their places; only sums by centre and candidate, and the few rows that may open, come to the driver. Points of
up to LOCAL_ROWS rows, which are counted first, are held there instead, and the same sums are made without jobs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .metric import matrix, squares

#: Rows that are held on the driver; rows that may open in one step of `opened`; candidates of one pass.
LOCAL_ROWS, STEP_ROWS, CANDIDATES = 20_000, 2_000, 256


@dataclass
class Points:
    """id, v, weight, and draw and order: uniform hashes of the id, which decide on opening and give the sequence of points."""

    table: DataFrame
    count: int
    held: dict[str, Any] | None = field(default=None)

    def sums(self, kernel: Callable) -> Any:
        """The sum of kernel(x, weight), an array of one shape, over all points."""
        import numpy as np

        if self.held is not None:
            return kernel(self.held["x"], self.held["weight"])
        shape = kernel(np.zeros((1, len(self.table.select("v").first()[0]))), np.zeros(1)).shape

        def mapped(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros(shape)
            for b in batches:
                if b.num_rows:
                    total += kernel(matrix(b["v"]), b["weight"].to_numpy())
            flat = total.ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["place", "total"])

        found = self.table.select("v", "weight").mapInArrow(mapped, "place long, total double").groupBy("place").agg(F.sum("total")).collect()
        out = np.zeros(math.prod(shape))
        for place, total in found:
            out[place] = total
        return out.reshape(shape)

    def least(self, key: str, n: int) -> list:
        """The n rows (id, x, weight) of smallest draw by key: order, or weighted, whose chance is in proportion to the weight."""
        import numpy as np

        if self.held is not None:
            h = self.held
            by = np.argsort(h["order"] if key == "order" else -np.log(h["draw"]) / np.maximum(h["weight"], 1e-300), kind="stable")[:n]
            return [(h["id"][i], h["x"][i], h["weight"][i]) for i in by]
        by = F.col("order") if key == "order" else -F.log("draw") / F.greatest("weight", F.lit(1e-300))
        return [(r["id"], np.array(r["v"]), r["weight"]) for r in self.table.orderBy(by).limit(n).collect()]

    def may_open(self, centres: Any, z: float, low: float, high: float) -> list:
        """(order, draw, id, x, weight) of the points in [low, high) of the sequence whose draw is under cost / z, in sequence."""
        import numpy as np

        def chosen(x, weight, draw):
            return draw * z < weight * squares(x, centres).min(1)

        if self.held is not None:
            h = self.held
            at = np.flatnonzero((h["order"] >= low) & (h["order"] < high))
            at = at[chosen(h["x"][at], h["weight"][at], h["draw"][at])]
            return sorted(((h["order"][i], h["draw"][i], h["id"][i], h["x"][i], h["weight"][i]) for i in at), key=lambda r: r[0])

        def mapped(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    yield b.filter(pa.array(chosen(matrix(b["v"]), b["weight"].to_numpy(), b["draw"].to_numpy())))

        some = self.table.filter((F.col("order") >= low) & (F.col("order") < high))
        rows = some.mapInArrow(mapped, some.schema).limit(STEP_ROWS + 1).collect()
        return sorted(((r["order"], r["draw"], r["id"], np.array(r["v"]), r["weight"]) for r in rows), key=lambda r: r[0])


def weighted_points(rows: DataFrame, seed: int = 1) -> Points:
    """Points of rows (id, v, weight)."""
    import numpy as np

    uniform = lambda salt: (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(salt)), 11).cast("double") + 0.5) / float(1 << 53)
    table = rows.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"), F.col("weight").cast("double").alias("weight")).filter("v IS NOT NULL AND weight > 0")
    table = cut(table.withColumns({"draw": uniform(1), "order": uniform(2)}))
    count = table.count()
    held = None
    if 0 < count <= LOCAL_ROWS:
        t = table.orderBy("order").collect()
        held = {c: np.array([r[c] for r in t]) for c in ("weight", "draw", "order")} | {"id": [r["id"] for r in t], "x": np.array([r["v"] for r in t])}
    return Points(table, count, held)


def cost_of(points: Points, centres: Any) -> float:
    return float(points.sums(lambda x, w: (w * squares(x, centres).min(1)).sum(keepdims=True))[0])


def opened(points: Points, z: float) -> list:
    """Centres (id, x) of one pass over the sequence: a point opens if its draw is under its cost / z, its cost being that of the centres opened before it.

    Steps of the sequence take all points that may open under the centres so far, a superset, and decide on those in order, so the outcome is that of
    the pass point by point. A step that has too many is halved.
    """
    import numpy as np

    first = points.least("order", 1)[0]
    centres = [(first[0], first[1])]
    low, step = 0.0, min(1.0, STEP_ROWS / points.count)
    while low < 1:
        rows = points.may_open(np.array([c for _, c in centres]), z, low, low + step)
        if len(rows) > STEP_ROWS and step > 1e-12:
            step /= 2
            continue
        new: list = []
        for _, draw, i, x, weight in rows:
            near = squares(x[None], np.array(new)).min() if new else np.inf
            if i != first[0] and draw * z < weight * near:
                centres.append((i, x))
                new.append(x)
        low += step
        step *= 2
    return centres


def opening_sums(points: Points, centres: Any, candidates: Any) -> Any:
    """(saved, stays), each by candidate and present centre: what points save that are nearer to the candidate, and what the others would lose by going there."""
    import numpy as np

    def kernel(x, w):
        d = squares(x, centres)
        own = d.argmin(1)
        change = w[:, None] * (squares(x, candidates) - d[np.arange(len(x)), own][:, None])
        out = np.zeros((2, len(candidates), len(centres)))
        for side, part in enumerate((np.minimum(change, 0), np.maximum(change, 0))):
            for m in range(len(candidates)):
                out[side, m] = np.bincount(own, part[:, m], len(centres))
        return out

    return points.sums(kernel)


def opening_gains(points: Points, centres: Any, candidates: Any, z: float) -> tuple[Any, Any]:
    """(gain, closes) of opening each candidate at cost z: savings less z, and z less the loss of each centre that is cheaper to close; closes by centre."""
    saved, stays = opening_sums(points, centres, candidates)
    closing = z - stays
    return -z - saved.sum(1) + closing.clip(min=0).sum(1), closing > 0


def searched(points: Points, centres: list, feasible: list, z: float, accuracy: float, passes: int) -> list:
    """Centres after opening the best candidate again and again, until all candidates together can't gain that share of the cost."""
    import numpy as np

    cost = cost_of(points, np.array([c for _, c in centres])) + z * len(centres)
    for _ in range(passes):
        held = np.array([c for _, c in centres])
        taken = {i for i, _ in centres}
        some = [f for f in feasible if f[0] not in taken]
        if not some:
            break
        gain, closes = opening_gains(points, held, np.array([f[1] for f in some]), z)
        best = int(gain.argmax())
        if gain[best] * len(some) <= accuracy * cost:
            break
        centres = [c for c, gone in zip(centres, closes[best]) if not gone] + [some[best][:2]]
        cost -= gain[best]
    return centres


def k_median(points: Points, least: int, most: int) -> list:
    """Between least and most centres (id, x): the cost of a centre is searched by halving until the local search leaves so many, or its bounds meet."""
    import numpy as np

    if points.count <= most:
        return [(i, x) for i, x, _ in points.least("order", points.count)]
    low, high = 0.0, cost_of(points, np.array([points.least("order", 1)[0][1]]))
    feasible = points.least("weighted", min(CANDIDATES, points.count, max(1, int(3 * least * math.log(max(2, least))))))
    z = high / 2
    centres = opened(points, z)
    while len(centres) < least and low < 0.999 * high:
        high = z
        z = (high + low) / 2
        centres = opened(points, z)
    feasible = feasible + [(i, x, 1.0) for i, x in centres[:CANDIDATES]]
    while True:
        passes = 3 * max(most, len(centres))
        centres = searched(points, centres, feasible, z, 0.1, passes)
        if 0.9 * least <= len(centres) <= 1.1 * most or least - 2 <= len(centres) <= most + 2:
            centres = searched(points, centres, feasible, z, 0.001, passes)
        if least <= len(centres) <= most or low >= 0.999 * high:
            return centres
        if len(centres) > most:
            low = z
        else:
            high = z
        z = (high + low) / 2


def drawn_to_members(points: Points, centres: list) -> list:
    """(id, x, weight): each centre as the weighted mean of its members, and their weight; centres without members are left out."""
    import numpy as np

    held = np.array([c for _, c in centres])

    def kernel(x, w):
        own = squares(x, held).argmin(1)
        wide = np.concatenate([x * w[:, None], w[:, None]], 1)
        return np.stack([np.bincount(own, wide[:, j], len(held)) for j in range(wide.shape[1])], 1)

    total = points.sums(kernel)
    return [(i, t[:-1] / t[-1], float(t[-1])) for (i, _), t in zip(centres, total) if t[-1] > 0]
