"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, found with block-max inverted indexes.

1. Terms (lower-case words) are counted by label over all labelled rows outside the held-out fold; rows of equal text count once. A term weighs
   its inverse document frequency times the root of its chi-square with the label, whichever label it goes with: no term is left out, but
   those that say nothing about the label count for little.
2. References are a sample of at most `references` labelled texts (half of them positive where there are so many), by hash: the bound on what
   the classifier is fitted to. Their vectors of all their terms go into an inverted index, whose postings are cut into blocks of references
   with the largest weight of each. References of the same leading term are in neighbouring blocks. The index is broadcast; the references'
   texts bound its size.
3. For each document the k nearest references by cosine are found exactly: blocks are taken by their largest possible similarity, and
   once k references beat the next block's, no posting of it or of a later one is read.
4. Neighbours vote with their similarity, shrunk to the base rate; a monotone table, fitted by pooled neighbours' votes of the references
   on each other (each without itself), makes the votes probabilities.

Evidence: the nearest references, and the terms shared with them by how much they contribute.

Nulls: a null text counts as empty; a text without vocabulary terms is nearest to none, and its score is the calibrated base rate of such
references. A label that is null or belongs to no document is not learnt from; labels that disagree on a document count as the larger.
Without labels every score is 0. Repeated rows are scored each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, give_back, id_and_text, id_back, lean, lean_numpy, materialize, opened, shared_model, table

WORD = r"[^\W_]+"
BLOCK = 64


def term_counts(text: str) -> dict[str, int]:
    import re
    from collections import Counter

    return Counter(re.findall(WORD, text.lower()))


def spans(starts, counts):
    """Positions s, s+1, ..., s+n-1 for each start and count, one after the other."""
    import numpy as np

    total = np.cumsum(counts)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - counts - starts, counts)


class BlockMaxIndex:
    """Postings of unit vectors by term, in slices of BLOCK references with the largest weight of each slice.

    vectors: a dict of term number to weight for each reference, or arrays (terms, weights) of it; terms are numbered from 0.
    """

    def __init__(self, vectors: list, labels: list[int], names: list[int | None]):
        import numpy as np

        vectors = [(np.fromiter(v, np.int64, len(v)), np.fromiter(v.values(), np.float64, len(v))) if isinstance(v, dict) else v for v in vectors]
        leading = [int(t[np.lexsort((t, -w))[0]]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (-labels[i], leading[i], i))
        self.place = np.argsort(np.array(order, int)) if order else np.zeros(0, int)
        self.labels, self.names, self.n = np.array([labels[i] for i in order], np.float64), [names[i] for i in order], len(order)
        term = np.concatenate([np.zeros(0, np.int64), *[vectors[i][0] for i in order]])
        ref = np.repeat(np.arange(self.n), [len(vectors[i][0]) for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([np.zeros(0), *[vectors[i][1] for i in order]])
        by = np.lexsort((ref, term))
        term, self.ref, self.weight = term[by], ref[by].astype(np.int32), weight[by]
        self.blocks = -(-self.n // BLOCK)
        key = term * max(1, self.blocks) + self.ref // BLOCK
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        # Slices: a term's postings in one block. Of each: where it starts, how long it is, its block and its largest weight.
        self.at, self.size = new, np.diff(np.append(new, len(key)))
        self.block, self.top = self.ref[new] // BLOCK, np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        terms = int(term[-1]) + 1 if len(term) else 0
        self.first = np.searchsorted(term[new], np.arange(terms + 1))
        self.read = 0  # postings looked at so far

    def nearest(self, terms, weights, k: int, without: int | None = None):
        """(references, similarities) of the k most similar to a vector, ties to the smaller place; only similarities above 0."""
        import numpy as np

        inside = terms < len(self.first) - 1
        terms, weights = terms[inside], weights[inside]
        counts = self.first[terms + 1] - self.first[terms]
        s = spans(self.first[terms], counts)
        own = np.repeat(weights, counts)
        block = self.block[s]
        upper = np.bincount(block, own * self.top[s], self.blocks)
        order = np.argsort(-upper, kind="stable")
        score = np.zeros(self.n)
        best, taken, least, step = np.zeros(0, int), 0, 0.0, 4
        while taken < len(order) and upper[order[taken]] > 0 and (len(best) < k or upper[order[taken]] >= least - 1e-12):
            now = np.zeros(self.blocks, bool)
            now[order[taken : taken + step]] = True
            taken, step = taken + step, step * 2
            on = now[block]
            size = self.size[s[on]]
            p = spans(self.at[s[on]], size)
            self.read += len(p)
            score += np.bincount(self.ref[p], np.repeat(own[on], size) * self.weight[p], self.n)
            found = np.flatnonzero(score > 0)
            if without is not None:
                found = found[found != without]
            rough = np.round(score[found], 12)
            if len(found) > 4 * k:
                keep = rough >= np.partition(rough, len(rough) - k)[len(rough) - k]
                found, rough = found[keep], rough[keep]
            best = found[np.lexsort((found, -rough))][:k]
            least = score[best[-1]] if len(best) == k else 0.0
        return best, score[best]


def monotone(x: list[float], y: list[int], weight: list[float]) -> tuple[list[float], list[float]]:
    """Pool-adjacent-violators: points of a rising step table from votes to the weighted share of positives."""
    groups: list[list[float]] = []
    for v, t, w in sorted(zip(x, y, weight)):
        if groups and groups[-1][3] == v:
            groups[-1][0] += t * w
            groups[-1][1] += w
        else:
            groups.append([t * w, w, v, v])
        while len(groups) > 1 and groups[-2][0] * groups[-1][1] >= groups[-1][0] * groups[-2][1]:
            last = groups.pop()
            groups[-1] = [groups[-1][0] + last[0], groups[-1][1] + last[1], groups[-1][2], last[3]]
    xs, ys = [], []
    for s, n, lo, hi in groups:
        p = (s + 0.5 * 0.1) / (n + 0.1)
        xs += [lo, hi]
        ys += [p, p]
    return xs, ys


class Model:
    """terms, weights: of all terms of the references; examples: (doc_id, label, counts of terms) of each reference; totals: labelled texts by label."""

    def __init__(self, terms: list[str], weights: list[float], examples: list[tuple[int, int, dict[str, int]]], totals: dict[int, int], k: int, shrink: float):
        import numpy as np

        self.terms, self.number, self.weights, self.k, self.shrink = terms, {t: i for i, t in enumerate(terms)}, np.array(weights), k, shrink
        self.base = sum(y for _, y, _ in examples) / max(1, len(examples))
        vectors = [self.unit(c) for _, _, c in examples]
        self.index = BlockMaxIndex(vectors, [y for _, y, _ in examples], [d for d, _, _ in examples])
        votes = [self.vote(*v, int(self.index.place[i]))[0] for i, v in enumerate(vectors)]
        drawn = {y: sum(e[1] == y for e in examples) for y in (0, 1)}
        self.xs, self.ys = monotone(votes, [y for _, y, _ in examples], [totals[y] / drawn[y] for _, y, _ in examples])

    def unit(self, counts: dict[str, int]):
        """(terms, weights) of a text's vector; terms that no reference has can't add to a similarity, and the length is that of the others."""
        import numpy as np

        known = [(n, c) for t, c in counts.items() if (n := self.number.get(t)) is not None]
        terms = np.array([n for n, _ in known], np.int64)
        w = (1 + np.log(np.array([c for _, c in known], np.float64))) * self.weights[terms] if known else np.zeros(0)
        on = w > 0
        return terms[on], w[on] / (float(np.sqrt(w @ w)) or 1.0)

    def vote(self, terms, weights, without: int | None = None):
        """(share of positive votes, neighbours, similarities)."""
        near, sims = self.index.nearest(terms, weights, self.k, without) if self.index.n else ((), ())
        if not len(near):
            return 0.0, [], []
        return (float((sims * self.index.labels[near]).sum()) + self.shrink * self.base) / (float(sims.sum()) + self.shrink), near, sims

    def score(self, text: str, evidence: bool = False):
        """(probability, names of the neighbours, shared terms)."""
        import numpy as np

        counts = term_counts(text)
        terms, weights = self.unit(counts)
        v, near, _ = self.vote(terms, weights)
        p = float(np.interp(v, self.xs, self.ys)) if self.xs else 0.0
        p = min(1.0, max(0.0, p))
        return (p, [self.index.names[i] for i in near], self.shared(terms, weights, near)) if evidence else (p, [], [])

    def shared(self, terms, weights, near) -> list[str]:
        import numpy as np

        out = []
        for t, w in zip(terms, weights):
            a, z = self.index.first[t], self.index.first[t + 1]
            p = spans(self.index.at[a:z], self.index.size[a:z])
            gain = w * float(self.index.weight[p][np.isin(self.index.ref[p], near)].sum())
            if gain > 0:
                out.append((-gain, self.terms[t]))
        return [t for _, t in sorted(out)]


#: Labels beyond this number are joined by a shuffle; up to it they are broadcast, at 12 bytes each.
BROADCAST_LABELS = 1_000_000


def labelled(docs: DataFrame, labels: DataFrame, learn) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): doc_id, text, digest, row, y of one row for each labelled text, with the largest label of its copies; and digest, row, y alone."""
    y = labels.filter("toxic is not null AND doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    y = y.filter(learn(F.col("doc_id")))
    y = F.broadcast(y) if y.count() <= BROADCAST_LABELS else y
    rows = rows.filter(learn(F.col("doc_id"))).join(y, "doc_id").withColumn("digest", F.sha2("text", 256)).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "toxicity-labelled")
    one = materialize(rows.groupBy("digest").agg(F.min("row").alias("row"), F.max("y").alias("y")), "toxicity-texts")
    return rows.drop("y").join(F.broadcast(one) if one.count() <= BROADCAST_LABELS else one, ["digest", "row"]), one


def fit(docs: DataFrame, labels: DataFrame, learn, references: int = 2000, k: int = 15, shrink: float = 0.5) -> Model:
    """learn: condition on doc_id for rows that may be learnt from."""
    import math

    rows, texts = labelled(docs, labels, learn)

    def distinct_terms(batches: Iterator) -> Iterator:
        import re

        import pandas as pd

        def frame(held):
            return pd.DataFrame([(t, a, b) for t, (a, b) in held.items()], columns=["term", "n0", "n1"])

        for pdf in batches:
            held: dict = {}
            for text, y in zip(pdf["text"], pdf["y"]):
                for t in set(re.findall(WORD, text.lower())):
                    c = held.setdefault(t, [0, 0])
                    c[y] += 1
                if len(held) > 300_000:
                    yield frame(held)
                    held = {}
            yield frame(held)

    n = {0: 0, 1: 0} | {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    if not n[0] + n[1]:
        return Model([], [], [], n, k, shrink)
    some = [texts.filter(F.col("y") == y).select("digest", "row").orderBy(F.xxhash64("digest", F.lit(11)), "digest").limit(references // 2) for y in (1, 0)]
    drawn = some[0].unionByName(some[1])  # at most `references` rows

    def counted(batches: Iterator) -> Iterator:
        for pdf in batches:
            counts = [term_counts(t) for t in pdf["text"]]
            yield pdf[["digest", "doc_id", "y"]].assign(terms=[list(c) for c in counts], times=[list(c.values()) for c in counts])

    drawn = rows.join(F.broadcast(drawn), ["digest", "row"], "left_semi").mapInPandas(counted, "digest string, doc_id long, y int, terms array<string>, times array<int>")
    drawn = materialize(drawn, "toxicity-references")
    mine = drawn.select(F.explode("terms").alias("term")).distinct()
    terms = rows.select("text", "y").mapInPandas(distinct_terms, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # The references' terms and no others come to the driver.
    names, weights, total = [], [], n[0] + n[1]
    for r in terms.join(F.broadcast(mine), "term", "left_semi").orderBy("term").toLocalIterator():
        b, a = r["n0"], r["n1"]
        c, d = n[1] - a, n[0] - b
        chi2 = (a * d - b * c) ** 2 * total / max(1, (a + b) * (c + d) * n[1] * n[0])
        names.append(r["term"])
        weights.append((math.log((1 + total) / (1 + a + b)) + 1) * math.sqrt(chi2))
    # A term is one string here, however many references have it, and rows are let go one by one.
    own = {t: t for t in names}
    examples = [(r["doc_id"], r["y"], dict(zip((own.get(t, t) for t in r["terms"]), r["times"]))) for r in drawn.orderBy("digest").toLocalIterator()]
    # The sample holds more positives than the labels do, and the calibration weights each class by how much of it was drawn.
    return Model(names, weights, examples, n, k, shrink)


def fitted(docs: DataFrame, labels: DataFrame, options: dict):
    """A broadcast of the model; what fitting held goes back to the system, for the driver lives on."""
    held = shared_model(docs.sparkSession, fit(docs, labels, lambda d: fold(d) != 0, **options))
    give_back()
    return held


def score_documents(docs: DataFrame, model, evidence: bool = False) -> DataFrame:
    """doc_id, score; with evidence also the nearest references and shared terms. model: a Model or a broadcast of one."""
    held = shared_model(docs.sparkSession, model) if isinstance(model, Model) else model

    def mapped(batches: Iterator) -> Iterator:
        import pandas as pd

        lean_numpy(32)
        m = opened(held)
        for pdf in batches:
            scores, near, shared = [], [], []
            for text in pdf["text"]:
                p, ids, terms = m.score(text or "", evidence)
                scores.append(p)
                near.append(ids)
                shared.append(terms)
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "score": scores})
            if evidence:
                out["neighbours"], out["terms"] = near, shared
            yield out
        del m
        give_back()

    return id_back(id_and_text(docs).mapInPandas(mapped, "doc_id string, score double" + (", neighbours array<long>, terms array<string>" if evidence else "")))


def toxicity_scores(docs: DataFrame, labels: DataFrame, evidence: bool = False, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; labels of held-out rows are not looked at."""
    scored = score_documents(docs, fitted(docs, labels, options), evidence)
    more = ["neighbours", "terms"] if evidence else []
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more)


def reject_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of docs that aren't predicted toxic, with the columns of docs. Texts are scored in place: no join."""
    held = fitted(docs, labels, options)
    place = docs.columns.index("text")

    def mapped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lean_numpy(32)
        m = opened(held)
        for b in batches:
            yield b.filter(pa.array([m.score(t or "")[0] < 0.5 for t in b.column(place).to_pylist()], pa.bool_()))
        del m
        give_back()

    return lean(docs).mapInArrow(mapped, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
