import random

import numpy as np
import pytest

from numeriq.llm.ngram_join import Powers, allowed, keep_one, near_duplicate_classes, ngram_sets, runs_for, sketches


def brute(rows, words=5, num=4, den=5):
    texts = sorted({t or "" for _, t in rows})
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    near = {i: {j for j in range(len(texts)) if i != j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])} for i in range(len(texts))}
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[i], *(label[j] for j in near[i])) if near[i] else label[i] for i in range(len(texts))]
    at = {t: i for i, t in enumerate(texts)}
    out = []
    for d, t in rows:
        i = at[t or ""]
        if not sets[i]:
            out.append((d, d, 1, 0))
            continue
        own = [e for e, u in rows if label[at[u or ""]] == label[i] and sets[at[u or ""]]]
        out.append((d, min((e for e in own if e is not None), default=None), len(own), len(near[i])))
    return sorted(map(str, out))


def some_rows(seed, groups=6, members=12):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(8, 120))]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [" ".join(passage + [word() for _ in range(rng.randrange(60))]) for _ in range(120)]
    rows += ["", None, "  ", "one", "ONE", "a b c d", "A  b\tc D", rows[0], rows[0].upper(), rows[1].replace(" ", "\n")]
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[3]), (None, rows[5]), (None, "alone without id here now and more")]


@pytest.mark.parametrize("options", [{}, {"small": 4, "block": 8}])
def test_classes_and_links_equal_brute_force(spark, options):
    rows = some_rows(1)
    df = spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, sid string, n int")
    got = near_duplicate_classes(df, **options)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicate_classes(df, small=32, block=100)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)
    kept = keep_one(df, small=32, block=100)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [0]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicate_classes(df).count() == 0 and keep_one(df).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (None, " ")], "doc_id long, text string")
    assert keep_one(blank).count() == 3


def test_hashes_and_sketches():
    powers = Powers()
    a, n = ngram_sets(["a b c d e f", "x a b c d e f", "", "q", "é b c d e"], 5, powers)
    assert n.tolist() == [2, 3, 0, 1, 1] and len(set(a[:2]) & set(a[2:5])) == 2
    b, _ = ngram_sets(["z z z z z z", "a b c d e f"], 5, powers)
    assert set(a[:2]) <= set(b)
    s = sketches(a, n)
    assert allowed(s[0], s[0], 2, 2, 0.8) and not allowed(s[0], s[3], 2, 1, 0.8) and s[2].sum() == 0
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(300):
        common = rng.integers(0, 2**63, 178).astype(np.uint64)
        sets = [np.unique(np.concatenate((common, rng.integers(0, 2**63, 22).astype(np.uint64)))) * np.uint64(2) for _ in range(2)]
        x, y = (sketches(np.sort(v), np.array([len(v)]))[0] for v in sets)
        missed += not allowed(x, y, len(sets[0]), len(sets[1]), 0.8)
    assert missed == 0 and runs_for(0.98, 3) >= runs_for(0.9, 3)
