import random
import re
import zlib
from collections import Counter

import pytest

from numeriq.llm import spelling
from numeriq.llm.common import table


def edits(w, letters):
    for i in range(len(w) + 1):
        for c in letters:
            yield w[:i] + c + w[i:]
            if i < len(w):
                yield w[:i] + c + w[i + 1 :]
        yield w[:i] + w[i + 1 :]


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters = sorted({c for w in words for c in w})
    near = {w: {x for x in edits(w, letters) if x in words and x != w} if len(w) < 1000 else {x for x in words if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)} for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def got(docs):
    return sorted(tuple(r) for r in spelling.variants(docs).collect())


def test_query_equals_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(spelling, "LEAST", 12)
    monkeypatch.setattr(spelling, "PART", 20)
    monkeypatch.setattr(spelling, "COMPARED", 4096)
    docs = table(spark, sf_dir, "documents")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(docs) == want and sum(r[4] for r in want) > 1000


@pytest.mark.parametrize("least", [2, 64])
def test_dense_and_long_words(spark, monkeypatch, least):
    """Every string over two letters, so each list is hot; long words that differ at their ends and middles; nulls, copies and other columns."""
    monkeypatch.setattr(spelling, "LEAST", least)
    monkeypatch.setattr(spelling, "PART", 9)
    rng = random.Random(1)
    dense = ["".join("ab"[i >> k & 1] for k in range(size)) for size in (5, 6, 7) for i in range(2**size) if rng.random() < 0.8]
    long = "".join(rng.choice("xyzÀÿ") for _ in range(40_000))
    more = [long, long[:-1], "q" + long[1:], long[:20_000] + "q" + long[20_001:], long[:20_001] + long[20_000:], "abcde" * 9, "abcde" * 8 + "abce", "kitten" * 8, "kitten" * 8 + "s"]
    words = [(w, rng.randrange(3, 40)) for w in dense + more]
    rows = [(i, " ".join(rng.choice((w, w.upper())) if w.isascii() else w for _ in range(n))) for i, (w, n) in enumerate(words)]
    rows += [(None, None), (None, "stone stone stone"), (1, ""), (2, "stane stane stane a1b2"), (2, "stane stane stane a1b2")]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, word string, n int")
    want = brute(rows)
    assert got(docs) == want and len([r for r in want if len(r[0]) > 30_000 and r[4]]) > 3


def test_no_words(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
    assert got(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")) == []
