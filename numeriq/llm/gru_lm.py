"""Log-likelihood of whole documents under a gated recurrent language model with a class-factored softmax.

Tokens: A-Z in lower case; runs of characters other than ASCII white space; then one end token.

1. Chunks. Each task turns whole documents into chunks of about `chunk_tokens` tokens (a longer document is a chunk of its own): the chunk's
   distinct tokens with their counts in training documents, and for each token its place among them. Chunks are a table in the shared folder;
   later passes read numbers and no text.
2. Counts. The chunks' distinct tokens are added up by token, combined per task first. The commonest tokens, `dictionary` of them at most, are
   broadcast with their counts. Only a chunk's other tokens are joined with their counts by a shuffle, where a token is a key with one row
   per chunk at most. N, V, the commonest words and the endings' sums are aggregates of the counts. All counts are exact.
3. Model: a GRU reads a symbol per token, the commonest words by themselves, all others by a class of their ending. It predicts the class of
   the next token (softmax over classes), then the word: within a class of common words by a second softmax from the same state, within a
   class of endings by the smoothed counts (c + 0.5) / (their sum + 0.5), where 0.5 is left for words that aren't known. So the probabilities
   of all continuations add up to one.
4. Training: each task trains a copy by truncated backpropagation (numpy, Adam at a falling rate) on every token of the training documents it
   holds, end tokens included: documents follow each other in a fixed number of lanes, with the state carried from window to window to the
   end of a document. Copies are averaged, weighted by their tokens, after each round; documents are dealt to rounds by hash, so that each is
   trained on once. What comes to the driver are the model's parameters.
5. Scoring: documents go through in lanes too, with the state carried to the end of each.

Nulls: a null text counts as empty (only the end token); a row with a null doc_id is held out. Rows that repeat doc_id and text get the same
scores, up to rounding. Without training rows N and V are 0 and the model is its start. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LONG_ROWS, fold, lean, lean_numpy, materialize, opened, shared_model, table

END = b""


@dataclass
class Shape:
    hidden: int = 16
    frequent: int = 512  # words that are symbols of their own
    per_class: int = 32
    endings: int = 15  # classes of the other words
    dictionary: int = 400_000

    @property
    def groups(self) -> int:
        return self.frequent // self.per_class

    @property
    def classes(self) -> int:
        return 1 + self.groups + self.endings

    @property
    def symbols(self) -> int:
        return 1 + self.frequent + self.endings


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def ending(token: bytes, endings: int) -> int:
    return zlib.crc32(token.rstrip(b".,;:!?")[-2:]) % endings


def class_table(shape: Shape):
    """(class, place within it) of each symbol: 0 is END, then the common words, then the endings."""
    import numpy as np

    s = np.arange(shape.symbols)
    common = (s - 1) // shape.per_class + 1
    own = (s > 0) & (s <= shape.frequent)
    return np.where(s == 0, 0, np.where(own, common, s - shape.frequent + shape.groups)).astype(np.int16), np.where(own, (s - 1) % shape.per_class, 0).astype(np.int16)


def start_parameters(shape: Shape, symbol_counts, seed: int = 5) -> dict:
    """Small random weights; biases give the counts' own distribution, so that training starts from the unigram model."""
    import numpy as np

    rng = np.random.default_rng(seed)
    h = shape.hidden
    cls, place = class_table(shape)
    total = np.bincount(cls, weights=symbol_counts + 0.5, minlength=shape.classes)
    inner = np.full((shape.groups, shape.per_class), math.log(0.5))
    s = np.arange(1, shape.frequent + 1)
    inner[cls[s] - 1, place[s]] = np.log(symbol_counts[s] + 0.5)
    small = lambda *d: (rng.standard_normal(d) / math.sqrt(h)).astype(np.float32)
    return {
        "x": 0.3 * small(shape.symbols, 3 * h), "u": 0.5 * small(h, 3 * h), "b": np.zeros(3 * h, np.float32),
        "wc": 0.1 * small(h, shape.classes), "bc": np.log(total / total.sum()).astype(np.float32),
        "wi": 0.1 * small(shape.groups, h, shape.per_class), "bi": inner.astype(np.float32),
    }


def by_step(n: int, steps: int, lanes: int, kind):
    """Room for (n, steps, lanes) numbers; those of a step are together, as steps apart by a power of two would take each other's cache lines."""
    import numpy as np

    return np.empty((steps, n, lanes), kind).transpose(1, 0, 2)


def forward(p: dict, inputs, h):
    """(states, what the way back needs) of a window. inputs: (steps, lanes); h and states: (hidden, ...), with a step's numbers together in
    memory and its lanes next to each other. Where END is read a document starts, from a state of zero."""
    import numpy as np

    n, (steps, lanes) = len(h), inputs.shape
    rows = p["x"] + p["b"]
    rows[:, : 2 * n] *= -1  # gates are 1 / (1 + exp(-x)); where exp is too large they are 0
    a = np.ascontiguousarray(rows[inputs].transpose(0, 2, 1)).transpose(1, 0, 2)
    gates, cand = a[: 2 * n], a[2 * n :]
    to_gates, to_cand = -np.ascontiguousarray(p["u"][:, : 2 * n].T), np.ascontiguousarray(p["u"][:, 2 * n :].T)
    goes_on = (inputs != 0).astype(h.dtype)
    before, reset, states = (by_step(n, steps, lanes, h.dtype) for _ in range(3))
    for t in range(steps):
        b, g, r, c, s = before[:, t], gates[:, t], reset[:, t], cand[:, t], states[:, t]
        np.multiply(h, goes_on[t], out=b)
        g += to_gates @ b
        with np.errstate(over="ignore"):
            np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        np.multiply(g[n:], b, out=r)
        c += to_cand @ r
        np.tanh(c, out=c)
        np.subtract(c, b, out=s)
        s *= g[:n]
        s += b
        h = s
    return states, (before, gates, reset, cand, goes_on)


def softmax_over(logits, at):
    """(log of the share of one row of each column, exp(logits) and their sums by column). Columns are shifted only where exp could overflow or vanish."""
    import numpy as np

    if logits.size:
        most = logits.max(0)
        if most.max() > 60 or most.min() < -60:
            logits -= most
    found = logits[at, np.arange(logits.shape[1])]
    np.exp(logits, out=logits)
    total = np.ones(len(logits), logits.dtype) @ logits
    return found - np.log(total), logits, total


def by_class(shape: Shape, targets, mask, cls):
    """(rows, classes, bounds): the places of the window's targets in order of class, and where each class of common words begins."""
    import numpy as np

    y = targets.reshape(-1)
    c = cls[y]
    rows = np.argsort(c, kind="stable")
    if not mask.all():
        rows = rows[mask.reshape(-1)[rows]]
    c = c[rows]
    return rows, y[rows], c, np.searchsorted(c, np.arange(1, shape.groups + 2))


def with_ones(states, rows):
    """The states at some places, and a row of ones that biases are multiplied by."""
    import numpy as np

    s = np.ones((len(states) + 1, len(rows)), states.dtype)
    s[:-1] = states.reshape(len(states), -1)[:, rows]
    return s


def class_logits(p: dict, s):
    import numpy as np

    return np.concatenate((p["wc"].T, p["bc"][:, None]), 1) @ s


def word_logits(p: dict, shape: Shape, s, bounds):
    """Logits of the words of their class for all targets that are common words: one array, so that what follows is done once for all classes."""
    import numpy as np

    weights = np.concatenate((p["wi"].transpose(0, 2, 1), p["bi"][:, :, None]), 2)
    out, first = np.empty((shape.per_class, bounds[-1] - bounds[0]), s.dtype), bounds[0]
    for k in range(shape.groups):
        a, z = bounds[k], bounds[k + 1]
        if a < z:
            out[:, a - first : z - first] = weights[k] @ s[:, a:z]
    return out


def gradients(p: dict, shape: Shape, inputs, targets, mask, h, cls, place):
    """(loss, gradients, last state) of one window. inputs, targets, mask: (steps, lanes); h: (hidden, lanes)."""
    import numpy as np

    n, (steps, lanes) = shape.hidden, inputs.shape
    states, (before, gates, reset, cand, goes_on) = forward(p, inputs, h)
    rows, y, c, bounds = by_class(shape, targets, mask, cls)
    s = with_ones(states, rows)
    count = max(1, len(rows))
    g: dict = {"wi": np.zeros_like(p["wi"]), "bi": np.zeros_like(p["bi"])}

    def back(logits, at):
        """The loss of a softmax, with the logits made their gradients."""
        logs, e, total = softmax_over(logits, at)
        total *= count
        e /= total
        e[at, np.arange(len(at))] -= 1 / count
        return -float(logs.sum()), e

    loss, e = back(class_logits(p, s), c)
    both, ds = s @ e.T, p["wc"] @ e
    g["wc"], g["bc"] = both[:n], both[n]
    first, end = bounds[0], bounds[-1]
    more, e = back(word_logits(p, shape, s, bounds), place[y[first:end]])
    loss += more
    for k in range(shape.groups):
        a, z = bounds[k], bounds[k + 1]
        if a < z:
            own = e[:, a - first : z - first]
            both = s[:, a:z] @ own.T
            g["wi"][k], g["bi"][k] = both[:n], both[n]
            ds[:, a:z] += p["wi"][k] @ own
    dstates = np.zeros((n, steps * lanes), s.dtype)
    dstates[:, rows] = ds
    dstates = np.ascontiguousarray(dstates.reshape(n, steps, lanes).transpose(1, 0, 2)).transpose(1, 0, 2)
    z, r = gates[:n], gates[n:]
    slope = gates * (1 - gates)
    slope[:n] *= cand - before
    slope[n:] *= before
    into_cand, kept = z * (1 - cand * cand), 1 - z
    from_gates, from_cand = p["u"][:, : 2 * n], p["u"][:, 2 * n :]
    into = by_step(3 * n, steps, lanes, s.dtype)
    dh = np.zeros((n, lanes), s.dtype)
    for t in range(steps - 1, -1, -1):
        dh += dstates[:, t]
        d = into[:, t]
        np.multiply(dh, into_cand[:, t], out=d[2 * n :])
        np.multiply(dh, slope[:n, t], out=d[:n])
        dreset = from_cand @ d[2 * n :]
        np.multiply(dreset, slope[n:, t], out=d[n : 2 * n])
        dh *= kept[:, t]
        dreset *= r[:, t]
        dh += dreset
        dh += from_gates @ d[: 2 * n]
        dh *= goes_on[t]
    flat = into.reshape(3 * n, -1)
    g["u"] = np.concatenate((before.reshape(n, -1) @ flat[: 2 * n].T, reset.reshape(n, -1) @ flat[2 * n :].T), 1)
    g["b"] = flat.sum(1)
    read = inputs.reshape(-1)
    g["x"] = np.stack([np.bincount(read, weights=row, minlength=shape.symbols) for row in flat], 1).astype(s.dtype)
    return loss, g, states[:, -1].copy()


def longest_first(documents: Iterable, ahead: int = 2_000_000) -> Iterator:
    """(name, symbols) in another order: always the longest of those that are held, about `ahead` symbols, so that lanes end at about the same time."""
    import heapq

    heap: list = []
    held = 0
    for number, (name, doc) in enumerate(documents):
        heapq.heappush(heap, (-len(doc), number, name, doc))
        held += len(doc)
        while held > ahead:
            _, _, name, doc = heapq.heappop(heap)
            held -= len(doc)
            yield name, doc
    while heap:
        yield heapq.heappop(heap)[2:]


def in_lanes(documents: Iterable, window: int, lanes: int):
    """Windows of documents that follow each other in lanes; only those in lanes are held. documents: (name, symbols that end with END).

    Yields (symbols, with the last one of the window before in front; sizes; lanes that go on, or None for all; for each lane the pieces
    (name, size, whether the document ends there)). Lanes without documents leave.
    """
    import numpy as np

    waiting = iter(documents)
    held: list = [(None, ())] * lanes
    at, last = [0] * lanes, np.zeros(lanes, np.int32)
    while True:
        symbols, sizes, pieces = np.zeros((len(held), window + 1), np.int32), np.zeros(len(held), np.int64), []
        symbols[:, 0] = last
        for i in range(len(held)):
            n, own, row = 0, [], symbols[i]
            while n < window:
                name, doc = held[i]
                a = at[i]
                if a == len(doc):
                    held[i], at[i] = next(waiting, (None, ())), 0
                    name, doc = held[i]
                    a = 0
                    if not len(doc):
                        break
                m = min(window - n, len(doc) - a)
                row[n + 1 : n + 1 + m] = doc[a : a + m]
                n, at[i] = n + m, a + m
                own.append((name, m, a + m == len(doc)))
            sizes[i] = n
            pieces.append(own)
        on = np.flatnonzero(sizes)
        if not len(on):
            return
        if len(on) < len(held):
            held, at, symbols, sizes, pieces = [held[i] for i in on], [at[i] for i in on], symbols[on], sizes[on], [pieces[i] for i in on]
        else:
            on = None
        last = symbols[:, -1]
        yield symbols, sizes, on, pieces


class Trainer:
    """Adam on windows of documents; gradients don't cross windows, states do. The rate falls with the root of the steps."""

    def __init__(self, p: dict, shape: Shape, rate: float, settle: int = 50):
        import numpy as np

        self.p, self.shape, self.rate, self.settle, self.steps, self.tokens = {k: v.copy() for k, v in p.items()}, shape, rate, settle, 0, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.cls, self.place = class_table(shape)

    def learn(self, documents: Iterable, window: int, lanes: int) -> float:
        """One pass over all symbols of documents, which end with END."""
        import numpy as np

        loss, h = 0.0, np.zeros((self.shape.hidden, lanes), np.float32)
        for symbols, sizes, on, _ in in_lanes(longest_first((None, d) for d in documents), window, lanes):
            h = h if on is None else h[:, on]
            s = np.ascontiguousarray(symbols.T)
            more, g, h = gradients(self.p, self.shape, s[:-1], s[1:], np.arange(window)[:, None] < sizes, h, self.cls, self.place)
            loss += more
            n = int(sizes.sum())
            self.tokens += n
            self.step(g, n / (window * lanes))
        return loss

    def step(self, g: dict, share: float) -> None:
        """share: how full the window was; few tokens move the model less."""
        import numpy as np

        self.steps += 1
        rate = share * self.rate / math.sqrt(1 + self.steps / self.settle)
        scale = min(1.0, 1.0 / max(math.sqrt(sum(float(np.vdot(x, x)) for x in g.values())), 1e-12))
        for k, x in g.items():
            m, v = self.m[k], self.v[k]
            x *= scale
            m += 0.1 * (x - m)
            x *= x
            x -= v
            x *= 0.001
            v += x
            self.p[k] -= rate / (1 - 0.9**self.steps) * m / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-7)


def window_scores(p: dict, shape: Shape, states, targets, mask, cls, place):
    """(places, natural log-probabilities: of the class and, for common words, of the word in its class) of a window's targets."""
    import numpy as np

    rows, y, c, bounds = by_class(shape, targets, mask, cls)
    s = with_ones(states, rows)
    out = softmax_over(class_logits(p, s), c)[0]
    first, end = bounds[0], bounds[-1]
    out[first:end] += softmax_over(word_logits(p, shape, s, bounds), place[y[first:end]])[0]
    return rows, out


def scored_in_lanes(p: dict, shape: Shape, documents: Iterable, window: int = 32, lanes: int = 256) -> Iterator:
    """(name, natural log-likelihood) of each (name, symbols), as documents end."""
    import numpy as np

    cls, place = class_table(shape)
    h = np.zeros((shape.hidden, lanes), np.float32)
    so_far: list[float] = [0.0] * lanes
    for symbols, sizes, on, pieces in in_lanes(longest_first(documents), window, lanes):
        if on is not None:
            h, so_far = h[:, on], [so_far[i] for i in on]
        s = np.ascontiguousarray(symbols.T)
        states, _ = forward(p, s[:-1], h)
        h = states[:, -1].copy()
        rows, logs = window_scores(p, shape, states, s[1:], np.arange(window)[:, None] < sizes, cls, place)
        each = np.zeros(window * len(sizes))
        each[rows] = logs
        sums = np.zeros((len(sizes), window + 1))
        np.cumsum(each.reshape(window, -1).T, axis=1, out=sums[:, 1:])
        for i, own in enumerate(pieces):
            a = 0
            for name, n, ends in own:
                so_far[i] += float(sums[i, a + n] - sums[i, a])
                a += n
                if ends:
                    yield name, so_far[i]
                    so_far[i] = 0.0


def score_symbols(p: dict, shape: Shape, documents: list, window: int = 32, lanes: int = 256) -> list[float]:
    """Natural log-likelihood of each array of symbols: class, and word of common words."""
    found = dict(scored_in_lanes(p, shape, enumerate(documents), window, lanes))
    return [found[i] for i in range(len(documents))]


CHUNK = "chunk long, tokens array<binary>, known array<long>, endings array<short>, doc_ids array<long>, train array<boolean>, sizes array<int>, codes binary"


def chunks(docs: DataFrame, shape: Shape, chunk_tokens: int) -> DataFrame:
    """Whole documents, encoded by the chunk's own list of tokens, of which END is the first; known: counts in training documents."""

    def encoded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        names = [c.split()[0] for c in CHUNK.split(", ")]

        class Places(dict):
            def __missing__(self, token):
                self[token] = n = len(self)
                return n

        def row(places, ids, train, codes):
            nonlocal number
            sizes, flat = np.array([len(c) for c in codes], np.int32), np.concatenate(codes)
            known = np.bincount(flat[np.repeat(np.array(train), sizes)], minlength=len(places))
            parts = [number], [list(places)], [known], [[ending(t, shape.endings) for t in places]], [ids], [train], [sizes], [flat.tobytes()]
            types = pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int16()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, types)], names=names)

        places, ids, train, codes, size = Places({END: 0}), [], [], [], 0
        for b in batches:
            for doc, text, learns in zip(*(b.column(i).to_pylist() for i in range(3))):
                codes.append(np.array(list(map(places.__getitem__, tokens_of(text))), np.int32))
                ids.append(doc)
                train.append(learns)
                size += len(codes[-1])
                if size >= chunk_tokens:
                    yield row(places, ids, train, codes)
                    places, ids, train, codes, size = Places({END: 0}), [], [], [], 0
        if ids:
            yield row(places, ids, train, codes)

    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(fold(F.col("doc_id")) != 1, F.lit(False)).alias("train"))
    return materialize(rows.mapInArrow(encoded, CHUNK), "lm-chunks", **LONG_ROWS)


def token_counts(held: DataFrame) -> DataFrame:
    """(token, c, ending) of every token of training documents."""
    each = held.select(F.explode(F.arrays_zip("tokens", "known", "endings")).alias("x")).select(F.col("x.tokens").alias("token"), F.col("x.known").alias("n"), F.col("x.endings").alias("ending"))
    return materialize(each.filter("n > 0").groupBy("token").agg(F.sum("n").alias("c"), F.max("ending").alias("ending")), "lm-counts")


def commonest(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Tokens by count, largest first, down to a count that at most so many have."""
    fine = F.floor(F.log2("c") * 64)
    bins = sorted(((r["b"], r["n"]) for r in counts.groupBy(fine.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)  # some thousand at most
    least, total = None, 0
    for b, n in bins:
        total += n
        if total > most:
            break
        least = b
    if least is None:
        return []
    return sorted(((bytes(r["token"]), r["c"]) for r in counts.filter(fine >= least).select("token", "c").collect()), key=lambda x: (-x[1], x[0]))


def common_words(counts: DataFrame, dictionary: list[tuple[bytes, int]], shape: Shape) -> list[tuple[bytes, int]]:
    """The commonest tokens of all training documents and their counts, END first; `frequent` + 1 at most."""
    top = dictionary
    if len(top) <= shape.frequent:
        top = [(bytes(r["token"]), r["c"]) for r in counts.orderBy(F.desc("c"), "token").limit(shape.frequent + 1).select("token", "c").collect()]
    return [(END, dict(top).get(END, 0)), *[x for x in top if x[0] != END][: shape.frequent]]


@dataclass
class Vocabulary:
    """Symbols of common words, counts of the dictionary, and the sums that smoothed counts need."""

    symbols: dict
    dictionary: dict
    counts: list
    mass: list
    train_tokens: int
    distinct: int


def vocabulary_of(counts: DataFrame, shape: Shape) -> Vocabulary:
    dictionary = commonest(counts, shape.dictionary)
    top = common_words(counts, dictionary, shape)
    by_ending = {r["ending"]: (r["n"], r["v"]) for r in counts.groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    tokens, distinct = sum(n for n, _ in by_ending.values()), sum(v for _, v in by_ending.values())
    for t, c in top:
        e = ending(t, shape.endings)
        if e in by_ending and c:
            n, v = by_ending[e]
            by_ending[e] = n - c, v - 1
    sums = [by_ending.get(e, (0, 0)) for e in range(shape.endings)]
    own = [c for _, c in top] + [0] * (shape.frequent + 1 - len(top))
    return Vocabulary({t: i for i, (t, _) in enumerate(top)}, dict(dictionary), own + [n for n, _ in sums], [0.5 + n + 0.5 * v for n, v in sums], tokens, distinct)


def other_counts(held: DataFrame, counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(chunk, back): (place, c) of the chunk's tokens that training documents have and the dictionary hasn't; as many as it has tokens at most."""
    ready = shared_model(held.sparkSession, vocabulary.dictionary)

    def others(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = opened(ready)
        for b in batches:
            for chunk, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                places = [i for i, t in enumerate(tokens) if t not in known]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(places), pa.int64()), pa.array(places, pa.int32()), pa.array([tokens[i] for i in places], pa.binary())], names=["chunk", "place", "token"])

    least = min(vocabulary.dictionary.values(), default=None)
    rare = counts.select("token", "c") if least is None else counts.filter(F.col("c") <= least).select("token", "c")
    asked = held.select("chunk", "tokens").mapInArrow(others, "chunk long, place int, token binary")
    return asked.join(rare, "token").groupBy("chunk").agg(F.collect_list(F.struct("place", "c")).alias("back"))


def chunk_symbols(vocabulary: Vocabulary, shape: Shape, tokens, endings):
    """The model's symbol of each of a chunk's tokens, an Arrow array: looked up there, as the tokens of a chunk are many and no objects of Python yet."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    found = pc.fill_null(pc.index_in(tokens, pa.array(list(vocabulary.symbols), pa.binary())), -1).to_numpy()
    return np.where(found < 0, 1 + shape.frequent + endings, found).astype(np.int32)


def chunk_documents(b, i: int):
    """(codes by document, ids, train, tokens, endings) of a chunk, row i of an Arrow batch with the columns of CHUNK."""
    import numpy as np

    get = lambda name: b.column(b.schema.get_field_index(name))[i]
    sizes = get("sizes").values.to_numpy(zero_copy_only=False)
    codes = np.split(np.frombuffer(get("codes").as_py(), np.int32), np.cumsum(sizes)[:-1])
    return codes, get("doc_ids").as_py(), get("train").as_py(), get("tokens").values, get("endings").values.to_numpy(zero_copy_only=False)


def pack_parameters(p: dict):
    import numpy as np

    return np.concatenate([p[k].reshape(-1) for k in sorted(p)])


def unpack_parameters(flat, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(like[k].dtype)
        at += like[k].size
    return out


def train_round(held: DataFrame, model, shape: Shape, window: int, lanes: int, rate: float, part: int = 0, parts: int = 1, piece: int = 2048):
    """The average of all tasks' copies after one pass over all tokens of the training documents of one part. model: a broadcast (vocabulary, parameters)."""
    import numpy as np

    def trained(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lean_numpy()
        vocabulary, start = opened(model)
        copy = Trainer(start, shape, rate)

        def documents():
            for b in batches:
                for i in range(b.num_rows):
                    codes, ids, train, tokens, endings = chunk_documents(b, i)
                    symbols = chunk_symbols(vocabulary, shape, tokens, endings)
                    for c, d, learns in zip(codes, ids, train):
                        if learns and zlib.crc32(b"%d" % d) // 5 % parts == part:
                            yield symbols[c]

        copy.learn(documents(), window, lanes)
        flat = pack_parameters(copy.p).astype(np.float64) * copy.tokens
        pieces = [flat[i : i + piece] for i in range(0, len(flat), piece)] if copy.tokens else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(pieces)), pa.int32()), pa.array([copy.tokens] * len(pieces), pa.int64()), pa.array(pieces, pa.list_(pa.float64()))], names=["part", "tokens", "values"]
        )

    def added(key, pdf):
        import pandas as pd

        return pd.DataFrame({"part": [key[0]], "tokens": [pdf["tokens"].sum()], "values": [np.sum(np.stack(pdf["values"].to_list()), axis=0)]})

    schema = "part int, tokens long, values array<double>"
    salted = held.mapInArrow(trained, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    sums = salted.groupBy("part", "salt").applyInPandas(added, schema).groupBy("part").applyInPandas(added, schema)
    found = sums.orderBy("part").collect()  # the model's parameters
    start = opened(model)[1]
    if not found:
        return start
    return unpack_parameters(np.concatenate([np.array(r["values"]) / r["tokens"] for r in found]), start)


def fit(held: DataFrame, vocabulary: Vocabulary, shape: Shape, rounds: int, window: int, lanes: int, rate: float) -> dict:
    import numpy as np

    p = start_parameters(shape, np.array(vocabulary.counts, np.float64))
    if vocabulary.train_tokens:
        for r in range(rounds):
            p = train_round(held, shared_model(held.sparkSession, (vocabulary, p)), shape, window, lanes, rate / (1 + r), r, rounds)
    return p


def score_chunks(held: DataFrame, counts: DataFrame, vocabulary: Vocabulary, p: dict, shape: Shape) -> DataFrame:
    """doc_id, train, n_tokens, n_known, logs, score of every document of the chunks."""
    ready = shared_model(held.sparkSession, (vocabulary, p))
    columns = ["doc_id", "train", "n_tokens", "n_known", "logs", "score"]

    def scored(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        lean_numpy()
        words, model = opened(ready)
        mass, log_mass = np.log10(0.5), np.log10(np.array(words.mass))

        def documents():
            for b in batches:
                for i in range(b.num_rows):
                    codes, ids, train, tokens, endings = chunk_documents(b, i)
                    get = words.dictionary.get
                    c = np.fromiter((get(t, 0) for t in tokens.to_pylist()), np.int64, len(tokens))
                    back = b.column(b.schema.get_field_index("back"))[i].values
                    if back is not None:
                        c[back.field("place").to_numpy()] = back.field("c").to_numpy()
                    symbols = chunk_symbols(words, shape, tokens, endings)
                    logs = np.where(c > 0, np.log10(c + 0.5), mass)
                    # What a token of a class of endings adds to the score besides P(class).
                    inner = np.where(symbols > shape.frequent, logs - log_mass[endings], 0.0)
                    for doc, learns, x in zip(ids, train, codes):
                        yield (doc, learns, len(x), int((c[x] > 0).sum()), float(logs[x].sum()), float(inner[x].sum())), symbols[x]

        def frame(rows):
            kinds = pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=columns)

        out = []
        for (*row, inner), logs in scored_in_lanes(model, shape, documents()):
            out.append((*row, logs / math.log(10) + inner))
            if len(out) >= 2000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    return held.join(other_counts(held, counts, vocabulary), "chunk", "left").mapInArrow(scored, "doc_id long, train boolean, n_tokens long, n_known long, logs double, score double")


def document_scores(docs: DataFrame, shape: Shape | None = None, rounds: int = 2, window: int = 32, lanes: int = 128, rate: float = 0.01, chunk_tokens: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    shape = shape or Shape()
    held = chunks(docs, shape, chunk_tokens)
    counts = token_counts(held)
    vocabulary = vocabulary_of(counts, shape)
    p = fit(held, vocabulary, shape, rounds, window, lanes, rate)
    bottom = math.log10(vocabulary.train_tokens + 0.5 * (vocabulary.distinct + 1))
    return score_chunks(held, counts, vocabulary, p, shape).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * bottom).alias("base_score"), "score",
    )


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_scores(table(spark, sf_dir, "documents"))
