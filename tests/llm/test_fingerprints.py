import hashlib
import random

import numpy as np
import pytest

from numeriq.llm import fingerprints as fp
from numeriq.llm.common import table
from pyspark.sql import functions as F


def toss(x, before):
    bit = 0
    while (x >> bit & 1) == (before >> bit & 1):
        bit += 1
    return 2 * bit + (x >> bit & 1)


def phrases(symbols):
    """One level as its docstring says, symbol by symbol."""
    segments, i = [], 0
    while i < len(symbols):
        j = i
        while j + 1 < len(symbols) and symbols[j + 1] == symbols[i]:
            j += 1
        if j > i:
            segments.append(("run", symbols[i : j + 1]))
        elif segments and segments[-1][0] == "mixed":
            segments[-1][1].append(symbols[i])
        else:
            segments.append(("mixed", [symbols[i]]))
        i = j + 1
    out = []
    for kind, part in segments:
        if kind == "run":
            out += [part[k : k + 4] for k in range(0, len(part), 4)]
            continue
        label = list(part)
        for _ in range(4):
            label = [toss(x, label[k - 1] if k else x ^ 1) for k, x in enumerate(label)]
        for colour in (5, 4, 3):
            new = list(label)
            for k, x in enumerate(label):
                if x == colour:
                    near = {label[k - 1] if k else None, label[k + 1] if k + 1 < len(label) else None}
                    new[k] = min({0, 1, 2} - near)
            label = new
        cuts = [0] + [k for k in range(1, len(part) - 1) if label[k - 1] < label[k] > label[k + 1]] + [len(part)]
        out += [part[a:b] for a, b in zip(cuts, cuts[1:])]
    return out


def test_levels_equal_a_plain_version():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé😀 ") for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["a", "aa", "aaaaaaaaab", "abababab" * 9, "x" * 100]
    symbols = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    text = np.repeat(np.arange(len(texts), dtype=np.uint32), [len(t) for t in texts])
    for level in (1, 2, 3):
        names, owner = fp.parsed(symbols, text, level)
        at, meaning = 0, {}
        for i in range(len(texts)):
            for p in phrases(symbols[text == i].tolist()):
                assert owner[at] == i and meaning.setdefault(int(names[at]), p) == p
                at += 1
        assert at == len(names) and len({tuple(p) for p in meaning.values()}) == len(meaning)
        symbols, text = names, owner


def test_equal_substrings_share_their_inside():
    rng = random.Random(5)
    passage = "".join(rng.choice("etaoin shrdlu") for _ in range(3000))
    other = ["".join(rng.choice("xyzw vjkq") for _ in range(n)) for n in (1, 7, 333)]
    a, *moved = fp.fingerprints_of([passage, *[o + passage for o in other]])
    assert all(fp.likeness(a, m) > 0.8 for m in moved)
    assert fp.likeness(a, fp.fingerprints_of([other[2] * 9])[0]) == 0
    assert fp.likeness("", "") == 1 and fp.likeness("", a) == 0 and fp.likeness(a, a) == 1
    assert fp.fingerprints_of([passage, "x", passage]) == [a, fp.fingerprints_of(["x"])[0], a]


def brute(rows):
    """rows: (doc_id, text, hash)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -r[2]))
    texts = [r[1] or "" for r in rows]
    out = []
    for (doc, *_), t, a in zip(rows, texts, texts[1:] + texts[:1]):
        h = len(t) // 2
        e = t[: len(t) - h] + a[:h]
        x, y, z = fp.fingerprints_of([t, e, a])
        out.append((doc, len(t), hashlib.sha256(e.encode()).hexdigest(), x, y, fp.likeness(x, y), fp.likeness(x, z)))
    return sorted(out, key=str)


def check(spark, docs):
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    got = fp.fingerprinted(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    return got


def test_query_equals_a_plain_version(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", 50_000)
    got = check(spark, table(spark, sf_dir, "documents"))
    # Half of the text is in common, and next documents are others.
    assert got.filter("near_edited < 0.2").count() == 0 and got.filter("near_next > 0.3 AND near_next < 1").count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 40])
def test_nulls_ties_repeats_and_small_tables(spark, n):
    rows = [(5, "tie one"), (5, "tie two"), (None, None), (None, "a"), (None, ""), (9, "ab" * 400_000), (8, "é😀"), (-(1 << 62), "x")] + [(7, "the same row")] * 20 + [(i, f"text {i} " * 9) for i in range(20, 40)]
    rows = [(*r, 1, "r") for r in rows[:n]]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, range int, hash string"))
