import hashlib
import zlib

import pytest

from numeriq.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, place string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    return sha(*map(field, (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"])))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(held, at):
    out = []
    for row in held[:-1]:
        out.append((row[at ^ 1] if at ^ 1 < len(row) else None, at & 1))
        at >>= 1
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for k in names:
        by[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[k] = levels([leaf(r) for r in by[k]])
    top = levels([trees[k][-1][0] for k in names])
    out = []
    for a, k in enumerate(names):
        for i, r in enumerate(by[k]):
            w = way(trees[k], i) + way(top, a)
            changed = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            d = leaf(r, int(changed))
            for s, right in w:
                d = sha(d) if s is None else sha(s, d) if right else sha(d, s)
            out.append((r["doc_id"], leaf(r), trees[k][-1][0], top[-1][0], sha(*[s for s, _ in w if s]), d, d == top[-1][0]))
    return sorted(out, key=str)


def written(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def got(spark, tmp_path, rows):
    return sorted(map(tuple, merkle.op11_merkle_manifest(spark, written(spark, tmp_path, rows)).collect()), key=str)


def as_dicts(rows):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]


def test_proofs_of_many_levels_nulls_and_repeats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 100)
    long = "é" * 300_000
    rows = [(i, f"text {i}", ("de", "en", "en", "zz")[i % 4], "web", i, "x", 1, "y") for i in range(1100)]
    rows += [(None, None, None, None, None, None, None, None)] * 3 + [(7, "", "", "", 0, None, None, None), (7, long, "é", None, None, None, None, None), (14, None, "one", "s", None, None, None, None)]
    rows += [(5, "copy", "en", "web", 4, "x", 1, "y")] * 400
    assert got(spark, tmp_path, rows) == brute(as_dicts(rows))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_smallest_tables(spark, tmp_path, n):
    rows = [(i, "a", "en", "web", 1, None, None, None) for i in range(n)]
    assert got(spark, tmp_path, rows) == brute(as_dicts(rows))


def test_a_few_leaves_are_asked_with_short_segments(spark):
    nodes = [("=a", i, 37, sha(str(i))) for i in range(37)] + [("=b", 0, 1, sha("b"))]
    records, roots = merkle.build(spark.createDataFrame(nodes, "tree string, place long, n long, digest string"), bits=2)
    asked = spark.createDataFrame([("=a", 0, "p"), ("=a", 36, "q"), ("=b", 0, "r")], "tree string, place long, tag string")
    found = {r["tag"]: r["siblings"] for r in merkle.descend(records, roots, asked, bits=2).collect()}
    held = levels([d for t, _, _, d in nodes if t == "=a"])
    assert found == {"p": [s for s, _ in way(held, 0)], "q": [s for s, _ in way(held, 36)], "r": []}
    assert {r["tree"]: r["digest"] for r in roots.collect()} == {"=a": held[-1][0], "=b": sha("b")}
