import math
import zlib
from collections import Counter

import numpy as np
import pytest

from numeriq.llm.common import fold, shared_model
from numeriq.llm.gru_lm import (
    END, Shape, Trainer, chunks, class_table, document_scores, ending, fit, gradients, longest_first, score_chunks, score_symbols, start_parameters, token_counts, tokens_of, train_round, vocabulary_of,
)
from numeriq.llm.toxicity import BlockMaxIndex, monotone, reject_toxic, toxicity_scores
from numeriq.llm.toxicity import fit as fit_toxicity
from pyspark.sql import functions as F


def test_block_max_index_equals_brute_force():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        v = {int(t): float(rng.random() + 0.01) for t in rng.integers(0, 40, rng.integers(0, 5))}
        n = math.sqrt(sum(x * x for x in v.values())) or 1
        vectors.append({t: x / n for t, x in v.items()})
    index = BlockMaxIndex(vectors, [i % 3 == 0 for i in range(700)], list(range(700)))
    for i in range(0, 700, 7):
        for without in (None, i):
            terms, weights = np.array(list(vectors[i]) + [999], int), np.array([*vectors[i].values(), 1.0])
            near, sims = index.nearest(terms, weights, 9, None if without is None else int(index.place[i]))
            want = sorted((-round(sum(w * v.get(t, 0) for t, w in vectors[i].items()), 12), int(index.place[j])) for j, v in enumerate(vectors) if j != without)
            want = [(s, j) for s, j in want if s < 0][:9]
            assert [j for _, j in want] == near.tolist() and np.allclose([-s for s, _ in want], sims)
            assert [index.names[j] for j in index.place.tolist()] == list(range(700))


def test_blocks_beyond_reach_are_not_read():
    rng = np.random.default_rng(3)
    vectors = [{i // 100: 0.9, 100 + int(rng.integers(0, 3)): math.sqrt(1 - 0.81)} for i in range(3000)]
    index = BlockMaxIndex(vectors, [0] * 3000, list(range(3000)))
    for i in range(0, 3000, 100):
        index.nearest(np.array(list(vectors[i])), np.array(list(vectors[i].values())), 15)
    assert index.read < 0.4 * sum(len(vectors[i].keys() & v.keys()) for i in range(0, 3000, 100) for v in vectors)


def test_monotone_is_monotone():
    xs, ys = monotone([0.1, 0.2, 0.3, 0.4, 0.5, 0.5], [0, 1, 0, 1, 1, 0], [1.0] * 6)
    assert xs == sorted(xs) and ys == sorted(ys) and 0 < ys[0] < ys[-1] < 1


def crc(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.fixture(scope="module")
def toxic(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 8 == 0
        t = list(rng.choice(words, rng.integers(5, 60)))
        if bad:
            t[rng.integers(len(t))] = str(rng.choice(["Vile", "NASTY", "grim"]))
        rows.append((i, " ".join(t), int(bad)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(5000, None, 0), (5001, "", 0), (None, "vile vile", 1), (5002, "x " * 100_000 + "vile", 1), (0, rows[0][1], 1)], "doc_id long, text string, score int")
    return docs, spark.createDataFrame([*labels, (1, None), (None, 1), (9999, 1)], "doc_id long, toxic int"), {r[0]: r[2] for r in rows}


def test_toxicity_on_the_held_out_fold(spark, toxic):
    docs, labels, truth = toxic
    got = toxicity_scores(docs, labels, evidence=True).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if crc(i) == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    rest = {r["doc_id"]: r for r in got if r["doc_id"] is None or r["doc_id"] >= 5000}
    assert [rest[i]["predicted"] for i in (5000, 5001, None, 5002)] == [0, 0, 1, 1] and all(0 <= r["score"] <= 1 for r in got)
    hit = rest[5002]
    assert hit["terms"][0] == "vile" and hit["neighbours"] and all(crc(i) != 0 for i in hit["neighbours"])
    kept = reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)


def test_toxicity_equals_brute_force(spark, toxic):
    docs, labels, _ = toxic
    options = {"references": 200, "k": 7}
    got = {(r["doc_id"], r["score"]) for r in toxicity_scores(docs, labels, **options).collect()}
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    y = {r["doc_id"]: int(r["toxic"]) for r in labels.collect() if r["toxic"] is not None and r["doc_id"] is not None}
    texts: dict = {}
    for i, t in rows:
        if i in y and crc(i) != 0:
            texts[t] = max(texts.get(t, 0), y[i])
    n = Counter(texts.values())
    df = {v: Counter(w for t, u in texts.items() if u == v for w in set(t.lower().split())) for v in (0, 1)}
    total = n[0] + n[1]

    def weight(w):
        a, b = df[1][w], df[0][w]
        return (math.log((1 + total) / (1 + a + b)) + 1) * math.sqrt((a * (n[0] - b) - b * (n[1] - a)) ** 2 * total / max(1, (a + b) * (total - a - b) * n[1] * n[0]))

    model = fit_toxicity(docs, labels, lambda d: fold(d) != 0, **options)
    names = [model.index.names[p] for p in model.index.place.tolist()]
    of = {i: t for i, t in rows if i is not None and t in texts}
    references = [(of[i], texts[of[i]]) for i in names]
    assert len(references) == 200 and sum(v for _, v in references) == 100
    vocabulary = {w for t, _ in references for w in t.lower().split()}

    def unit(t):
        v = {w: (1 + math.log(c)) * weight(w) for w, c in Counter(t.lower().split()).items() if w in vocabulary}
        s = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / s for w, x in v.items()}

    vectors = [(unit(t), v) for t, v in references]

    def vote(u, without=None):
        sims = sorted(((-round(sum(x * v.get(w, 0) for w, x in u.items()), 12), int(model.index.place[j]), l) for j, (v, l) in enumerate(vectors) if j != without))[:7]
        sims = [(-s, l) for s, _, l in sims if s < 0]
        return (sum(s * l for s, l in sims) + 0.5 * 0.5) / (sum(s for s, _ in sims) + 0.5) if sims else 0.0

    xs, ys = monotone([vote(u, j) for j, (u, _) in enumerate(vectors)], [v for _, v in vectors], [n[v] / 100 for _, v in vectors])
    found = dict(got)
    for i, t in rows[::25] + rows[-5:]:
        assert abs(found[i] - np.interp(vote(unit(t)), xs, ys)) < 1e-6


def test_toxicity_ignores_held_out_labels(spark, toxic):
    docs, labels, _ = toxic
    flipped = labels.withColumn("toxic", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((str(r["doc_id"]), r["score"]) for r in toxicity_scores(docs, x).collect()) for x in (labels, flipped))
    assert a == b
    assert {r["score"] for r in toxicity_scores(docs, labels.limit(0)).collect()} == {0.0} and toxicity_scores(docs.limit(0), labels).count() == 0


SMALL = Shape(hidden=3, frequent=4, per_class=2, endings=2)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in start_parameters(SMALL, np.arange(SMALL.symbols) + 1.0).items()}
    cls, place = class_table(SMALL)
    x = rng.integers(0, SMALL.symbols, (4, 3))
    y = rng.integers(0, SMALL.symbols, (4, 3))
    mask = rng.random((4, 3)) < 0.8
    h = rng.standard_normal((3, 3))
    _, g, _ = gradients(p, SMALL, x, y, mask, h, cls, place)
    for k, v in p.items():
        for i in rng.integers(0, v.size, 12):
            both = []
            for d in (1e-5, -1e-5):
                q = {a: b.copy() for a, b in p.items()}
                q[k].reshape(-1)[i] += d
                both.append(gradients(q, SMALL, x, y, mask, h, cls, place)[0] / mask.sum())
            assert abs((both[0] - both[1]) / 2e-5 - g[k].reshape(-1)[i]) < 1e-6, k


def plain_score(p, shape, symbols):
    """A document's natural log-likelihood, a token and a state at a time."""
    cls, place = class_table(shape)
    h, last, total, n = np.zeros(shape.hidden), 0, 0.0, shape.hidden
    for y in symbols:
        a = p["x"][last].astype(float) + p["b"]
        z, r = np.split(1 / (1 + np.exp(-(a[: 2 * n] + h @ p["u"][:, : 2 * n]))), 2)
        h = h + z * (np.tanh(a[2 * n :] + (r * h) @ p["u"][:, 2 * n :]) - h)
        c = h @ p["wc"] + p["bc"]
        total += c[cls[y]] - np.log(np.exp(c).sum())
        if 0 < y <= shape.frequent:
            w = h @ p["wi"][cls[y] - 1] + p["bi"][cls[y] - 1]
            total += w[place[y]] - np.log(np.exp(w).sum())
        last = y
    return total


def test_continuations_add_up_to_one_and_windows_carry_state():
    p = start_parameters(SMALL, np.arange(SMALL.symbols) + 1.0, seed=1)
    rng = np.random.default_rng(1)
    head = rng.integers(1, SMALL.symbols, 5)
    scores = [np.exp(score_symbols(p, SMALL, [np.append(head, s)])[0] - score_symbols(p, SMALL, [head])[0]) for s in range(SMALL.symbols)]
    assert abs(sum(scores) - 1) < 1e-4
    docs = [np.append(rng.integers(1, SMALL.symbols, n), 0) for n in (1, 200, 7, 64, 65, 0)]
    want = [plain_score(p, SMALL, d) for d in docs]
    for window, lanes in ((8, 2), (500, 1), (3, 50)):
        assert np.allclose(score_symbols(p, SMALL, docs, window, lanes), want, rtol=1e-4)
    p["bc"] += np.array([0, 90, -90] + [0] * (SMALL.classes - 3), np.float32)  # where exp would overflow
    assert np.allclose(score_symbols(p, SMALL, docs, 8, 2), [plain_score(p, SMALL, d) for d in docs], rtol=1e-4)


def test_longest_first_keeps_every_document():
    docs = [(i, [0] * n) for i, n in enumerate((3, 9, 1, 7, 2, 8, 0, 5))]
    got = list(longest_first(docs, 12))
    assert sorted(got) == docs and got[0][0] == 1 and [len(d) for _, d in longest_first(docs, 10**9)] == [9, 8, 7, 5, 3, 2, 1, 0]


def counted(texts):
    counts = Counter(t for i, x in texts if crc(i) != 1 for t in tokens_of(x))
    return counts, sum(counts.values())


def test_language_model(spark):
    rng = np.random.default_rng(9)
    langs = [[f"{a}{i}{e}" for i in range(60)] for a, e in (("the", "ing"), ("un", "eux"))]
    texts = {i: " ".join(rng.choice(langs[i % 2], 80)) for i in range(600)}
    texts |= {1000: None, 1001: "", 1002: " \t\n\x0b ", 1003: "É É new\x85word NEW\x85WORD", 1004: "theing " * 30_000}
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in texts.items()], "doc_id long, text string, score double").repartition(3)
    shape = Shape(frequent=64, per_class=16, endings=7, dictionary=90)
    options = {"rounds": 2, "window": 16, "lanes": 8, "rate": 0.02}
    held = chunks(docs, shape, 2000)
    counts_ = token_counts(held)
    vocabulary = vocabulary_of(counts_, shape)
    p = fit(held, vocabulary, shape, **options)
    got = {r["doc_id"]: r for r in document_scores(docs, shape, **options).collect()}
    scored = {r["doc_id"]: r["score"] for r in score_chunks(held, counts_, vocabulary, p, shape).collect()}
    counts, n = counted(texts.items())
    v = len(counts)
    top = sorted((x for x in counts if x != END), key=lambda t: (-counts[t], t))[: shape.frequent]
    symbols = {END: 0} | {t: i + 1 for i, t in enumerate(top)}
    mass = [0.5 + sum(c + 0.5 for t, c in counts.items() if t not in symbols and ending(t, 7) == e) for e in range(7)]
    for i, x in texts.items():
        toks = tokens_of(x)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(toks), sum(t in counts for t in toks), n, crc(i) == 1)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks)
        assert abs(r["base_score"] - base) < 1e-6 * len(toks) + 1e-9
        if i % 20 == 0 or i > 999:  # the whole score, by a plain loop
            own = [symbols.get(t, 1 + shape.frequent + ending(t, 7)) for t in toks]
            rest = sum(math.log10((counts[t] + 0.5) / mass[ending(t, 7)]) for t in toks if t not in symbols)
            assert abs(scored[i] - (plain_score(p, shape, own) / math.log(10) + rest)) < 1e-3 * len(toks)
    held_out = [i for i in range(600) if crc(i) == 1]
    assert sum(got[i]["score"] for i in held_out) > sum(got[i]["base_score"] for i in held_out) + 10 * len(held_out)


def test_language_model_ties_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, "a c", 1), (2, "zz yy", 1)], "doc_id long, text string, tokens int")
    got = document_scores(docs, Shape(frequent=64, per_class=16, dictionary=1), rounds=1).collect()
    counts, n = counted(((1, "a b"), (1, "a b"), (2, "zz yy")))
    assert len(got) == 4 and {r["train_tokens"] for r in got} == {n}
    same = [r for r in got if r["doc_id"] == 1]
    assert abs(same[0]["score"] - same[1]["score"]) < 1e-5 and [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    for r in got:
        toks = tokens_of({1: "a b", None: "a c", 2: "zz yy"}[r["doc_id"]])
        assert r["n_known"] == sum(t in counts for t in toks)
        assert abs(r["base_score"] - sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (len(counts) + 1))) for t in toks)) < 1e-9
    assert document_scores(docs.limit(0)).count() == 0
    untaught = document_scores(docs.filter("doc_id is null"), SMALL).collect()
    assert [(r["train_tokens"], r["n_known"], r["base_score"]) for r in untaught] == [(0, 0, 0.0)] and untaught[0]["score"] < 0


def test_training_reads_every_token_to_the_end():
    rng = np.random.default_rng(6)
    p = start_parameters(SMALL, np.arange(SMALL.symbols) + 1.0)
    docs = [np.append(rng.integers(1, SMALL.symbols, n), 0).astype(np.int32) for n in (0, 500, 3, 49, 24, 1, 0, 130)]
    for lanes in (1, 3, 20):
        model = Trainer(p, SMALL, 0.0)  # at rate 0 the loss of the pass is that of the start, whatever the lanes
        loss = model.learn(iter(docs), 24, lanes)
        assert model.tokens == sum(map(len, docs)) and abs(loss + sum(score_symbols(p, SMALL, docs))) < 1e-3 * loss


def test_every_training_document_is_in_one_round(spark):
    texts = [(i, f"w{i} x") for i in range(200)]
    held = chunks(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), SMALL, 100)
    vocabulary = vocabulary_of(token_counts(held), SMALL)
    p = start_parameters(SMALL, np.array(vocabulary.counts, float))
    counts, _ = counted(texts)
    assert list(vocabulary.symbols)[:2] == [END, b"x"] and vocabulary.counts[:2] == [counts[END], counts[b"x"]] and len(vocabulary.symbols) == 5
    each = [train_round(held, shared_model(spark, (vocabulary, p)), SMALL, 8, 4, 0.01, r, 2) for r in (0, 1)]
    assert all((q["bc"] != p["bc"]).any() for q in each) and (each[0]["bc"] != each[1]["bc"]).any()


def test_an_index_of_arrays_is_that_of_dicts_and_the_model_leaves_the_driver(spark, sf_dir):
    import gc

    from numeriq.llm import toxicity

    rng = np.random.default_rng(8)
    vectors = [{int(t): float(w) for t, w in zip(rng.permutation(30)[:n], rng.choice([0.1, 0.3, 0.5], n))} for n in rng.integers(0, 9, 200)]
    labels = rng.integers(0, 2, 200).tolist()
    one = toxicity.BlockMaxIndex(vectors, labels, list(range(200)))
    two = toxicity.BlockMaxIndex([(np.array(list(v), np.int64), np.array(list(v.values()), float)) for v in vectors], labels, list(range(200)))
    for name in ("place", "labels", "ref", "weight", "at", "size", "block", "top", "first"):
        assert np.array_equal(getattr(one, name), getattr(two, name))
    docs, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    kept = toxicity.reject_toxic(docs, marks)
    gc.collect()
    assert not any(type(x) is toxicity.Model for x in gc.get_objects()) and kept.count() > 0


def test_a_task_holds_one_chunk_at_once(spark):
    """A task holds whole row groups of the table of chunks: each is one chunk, however many of them a task writes."""
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, " ".join(f"{i}w{j}" for j in range(2000))) for i in range(16)], "doc_id long, text string").coalesce(1)
    (file,) = chunks(docs, Shape(), 1000).inputFiles()
    meta = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert meta.num_rows == meta.num_row_groups == 16


def test_a_step_is_together_in_memory_and_a_window_has_one_softmax_over_words(monkeypatch):
    from numeriq.llm import gru_lm

    shape = gru_lm.Shape()
    p = start_parameters(shape, np.arange(shape.symbols) + 1.0)
    rng = np.random.default_rng(3)
    x, h = rng.integers(0, shape.symbols, (33, 8)).astype(np.int32), np.zeros((shape.hidden, 8), np.float32)
    p["x"][1] = -200  # gates at their limits
    states, kept = gru_lm.forward(p, x[:-1], h)
    assert all(a[:, 3].flags.c_contiguous and np.isfinite(a).all() for a in (states, *kept[:4])) and states.shape == (shape.hidden, 32, 8)
    calls, own = [], gru_lm.softmax_over
    monkeypatch.setattr(gru_lm, "softmax_over", lambda logits, at: calls.append(1) or own(logits, at))
    cls, place = gru_lm.class_table(shape)
    gru_lm.gradients(p, shape, x[:-1], x[1:], np.ones((32, 8), bool), h, cls, place)
    assert len(calls) == 2


def test_symbols_of_a_chunk():
    import pyarrow as pa

    from numeriq.llm.gru_lm import Shape, Vocabulary, chunk_symbols

    v = Vocabulary({b"": 0, b"a": 1, b"b": 2}, {}, [], [], 0, 0)
    tokens = pa.array([b"no", b"", b"b", b"x", b"a", b"no"], pa.binary())
    assert chunk_symbols(v, Shape(), tokens[1:], np.array([3, 3, 14, 0, 5], np.int16)).tolist() == [0, 2, 513 + 14, 1, 513 + 5]
    assert len(chunk_symbols(Vocabulary({b"": 0}, {}, [], [], 0, 0), Shape(), tokens[:0], np.array([], np.int16))) == 0
