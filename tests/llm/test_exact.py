import math
import random

import duckdb
import pytest

from numeriq.llm import exact_dedup, queries
from numeriq.llm.exact_dedup import build_index, deduplicate, directory, exact_groups
from numeriq.llm.voronoi_knn import routed_blocks, top_inner_products
from pyspark.sql import functions as F


def oracle(name, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels"):
        c.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    r = c.sql(queries.ORACLES[name])
    return r.columns, r.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    columns, want = oracle(name, sf_dir)
    got = [tuple(r) for r in queries.QUERIES[name](spark, sf_dir).select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


DOCS = [(1, "Aa"), (2, "aA"), (9, "É"), (8, "é"), (3, None), (4, ""), (None, "aa"), (5, "x" * 200_000), (6, "X" * 200_000), (7, "b"), (7, "b"), (None, None)]


@pytest.mark.parametrize("key", [None, lambda b: len(b) % 3, lambda b: 0])
def test_groups_hold_under_weak_keys(spark, key):
    docs = spark.createDataFrame([(*d, "z", 1, 2) for d in DOCS], "doc_id long, text string, key string, sha int, keep_id int")
    got = exact_groups(docs, capacity=1, **({"key": key} if key else {}))
    want = []
    norm = lambda t: (t or "").encode().lower()
    for i, t in DOCS:
        same = [j for j, u in DOCS if norm(u) == norm(t)]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select("doc_id", "keep_id", "group_size", "kept").collect())
    stay = deduplicate(docs)
    assert stay.columns == docs.columns and sorted(r["doc_id"] for r in stay.collect()) == [2, 4, 6, 7, 7, 8, 9]


def test_directory_splits_only_overfull_buckets(spark):
    def of(keys, bits=8, step=2):
        def below(depth, prefixes):
            assert all(p < 1 << depth for p in prefixes) or not depth
            out = {}
            for k in keys:
                if k >> (bits - depth) in prefixes:
                    out[k >> (bits - depth - step)] = out.get(k >> (bits - depth - step), 0) + 1
            return out

        return directory(below, 4, step, bits)

    assert of([]) == [0] and of([1, 2, 3, 4]) == [0]
    assert of([0, 64, 128, 224, *range(240, 245)]) == [0, 128, 192, 224, 240, 244, 248] and {200, 201, 202, 204, 208, 224} < set(of([200] * 9))
    docs = spark.createDataFrame([(i, f"t{i % 400}") for i in range(1000)], "doc_id long, text string")
    _, index, firsts = build_index(docs, capacity=20)
    sizes = [r["count"] for r in index.groupBy("bucket").count().collect()]
    assert 10 < len(sizes) <= len(firsts) and max(sizes) <= 20 and index.count() == 400 and index.agg(F.max("chain")).first()[0] == 1
    first = index.groupBy("bucket").agg(F.min(F.col("key").bitwiseXOR(F.lit(-(1 << 63)))).alias("low")).collect()
    assert all(r["low"] + (1 << 63) >= firsts[r["bucket"]] for r in first)
    assert exact_groups(docs.limit(0)).count() == 0


def test_groups_come_from_the_index(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i % 4}") for i in range(10)], "doc_id long, text string")
    prints, index, firsts = build_index(docs, key=lambda b: 7)
    assert sorted(r["chain"] for r in index.collect()) == [1, 2, 3, 4]
    monkeypatch.setattr(exact_dedup, "build_index", lambda d: (prints, index.filter("chain > 1"), firsts))
    assert exact_groups(docs).count() == 10 - index.filter("chain = 1").first()["group_size"]


def brute(rows, k):
    v = {}
    ok = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    for i, e in ok:
        if i % 50 == 0:
            v[i] = min(v.get(i, e), e)
    out = []
    for q, e in v.items():
        s = sorted((-sum(a * b for a, b in zip(e, d)), j) for j, d in ok if j != q)[:k]
        out += [(q, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out)


def test_topk_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(300)]  # one hot vector
    rows += [(2000, None), (2001, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (2002, [float("nan")] * 6), (2050, [float("inf")] * 6), (2003, []), (2004, [9.0]), (2100, [1.0, 1.0])]
    df = spark.createDataFrame([(i, e, "z", 1) for i, e in rows], "vec_id long, embedding array<double>, cell string, v int")
    for options in ({}, {"pivots": 5, "block_rows": 32, "query_rows": 4}):
        got = top_inner_products(df, F.col("vec_id") % 50 == 0, **options)
        assert sorted(map(tuple, got.collect())) == brute(rows, 5)
    zero = df.unionByName(spark.createDataFrame([(3000, [0.0] * 6, "z", 1), (3001, [0.0] * 6, "z", 1)], df.schema))
    assert sorted(map(tuple, top_inner_products(zero, F.col("vec_id") % 50 == 0, pivots=5, block_rows=32).collect())) == brute([*rows, (3000, [0.0] * 6), (3001, [0.0] * 6)], 5)
    again = df.unionByName(df.filter("vec_id in (50, 51)"))
    for pivots in (5, 64):
        assert sorted(map(tuple, top_inner_products(again, F.col("vec_id") % 50 == 0, pivots=pivots).collect())) == brute(rows + [r for r in rows if r[0] in (50, 51)], 5)
    assert top_inner_products(df.filter("vec_id in (1, 50)"), F.col("vec_id") % 50 == 0).count() == 1
    assert top_inner_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_ships_what_the_bounds_leave(spark):
    rng = random.Random(1)
    far = [[60.0 * (c == j) for j in range(20)] for c in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.01) for x in far[i % 20]]) for i in range(4000)]
    rows += [(10_000 + i, [9 * x + rng.gauss(0, 0.01) for x in far[i % 20]]) for i in range(200)]  # of larger norm
    df = spark.createDataFrame(rows + [rows[50], rows[100]], "vec_id long, embedding array<double>")  # two query ids occur twice
    asked = F.col("vec_id") % 50 == 0
    assert sorted(map(tuple, top_inner_products(df, asked, pivots=40, block_rows=32).collect())) == brute(rows + [rows[50], rows[100]], 5)
    blocks, queries, routes, _ = routed_blocks(df, asked, pivots=40, block_rows=32)
    pairs = routes.join(queries, ["cell", "part_of"]).join(blocks.groupBy("block").count(), "block").agg(F.sum("count")).first()[0]
    assert pairs < 0.1 * queries.count() * blocks.count()


def test_steps_of_dedup_have_two_python_workers_at_most(spark, monkeypatch):
    """A task runs a worker for each step in Python between two shuffles, and workers live on."""
    from numeriq.llm import exact_dedup

    plans = {}
    monkeypatch.setattr(exact_dedup, "materialize", lambda df, name, own=exact_dedup.materialize: plans.update({name: df}) or own(df, name))
    docs = spark.createDataFrame([(i, f"Text {i % 7}") for i in range(50)], "doc_id long, text string")
    assert exact_dedup.exact_groups(docs).filter("kept").count() == 7

    def deepest(node, above=0):
        here = 0 if "Exchange" in node.nodeName() else above + ("Python" in node.nodeName() or "InArrow" in node.nodeName())
        return max([here, *(deepest(node.children().apply(i), here) for i in range(node.children().size()))])

    depths = {name: deepest(df._jdf.queryExecution().sparkPlan()) for name, df in plans.items()}
    assert depths["dedup-fingerprints"] == 1 and max(depths.values()) == 2, depths
