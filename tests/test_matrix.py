"""The suppliers' matrix in bounded parts, and refinement that stores the rounded matrix once."""

import numpy as np

from numeriq.operators import solvers
from numeriq.plans import queries_numeric


def test_parts_of_the_matrix_grow_with_the_lines(spark, sf_dir, monkeypatch):
    usual = sorted(map(tuple, queries_numeric.matrix(spark, sf_dir).collect()))
    monkeypatch.setattr(queries_numeric, "TASK_ROWS", 500)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    many = queries_numeric.matrix(spark, sf_dir)
    assert f"REPARTITION_BY_NUM" in (plan := many._jdf.queryExecution().executedPlan().toString()) and f", {-(-2 * lines // 500)})" in plan
    assert sorted(map(tuple, many.collect())) == usual


def test_refinement_stores_the_rounded_matrix_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(solvers, "cut", lambda df, own=solvers.cut: stored.append(own(df)) or stored[-1])
    a = spark.createDataFrame([(i, j, 4.1 if i == j else -1.0) for i in range(6) for j in range(6) if abs(i - j) < 2], "i long, j long, v double")
    b = spark.createDataFrame([(i, float(i + 1)) for i in range(6)], "i long, x double")
    seen = []
    x, _ = solvers.refine(a, b, lambda m, r: seen.append(m) or solvers.conjugate_gradient(m, r, 8, 1e-8)[0], 4, lambda c: c.cast("float").cast("double"), 1e-12)
    assert len(seen) > 1 and all(m is stored[0] for m in seen) and stored[0].columns == ["i", "j", "v"]
    dense = np.diag([4.1] * 6) - np.eye(6, k=1) - np.eye(6, k=-1)
    assert np.allclose([r["x"] for r in x.orderBy("i").collect()], np.linalg.solve(dense, np.arange(1, 7)), atol=1e-10)


def test_products_are_added_up_in_blocks(spark, monkeypatch):
    from numeriq.operators import joins

    rng = np.random.default_rng(4)
    for size, dense in ((4, 1 << 20), (4, 0), (1024, 1 << 20)):
        monkeypatch.setattr(joins, "BLOCK", size)
        monkeypatch.setattr(joins, "DENSE", dense or 1)
        n = 23
        a, b = (np.where(rng.random((n, n)) < 0.3, rng.integers(-2, 3, (n, n)), 0) for _ in range(2))
        a[3, 5], b[5, 7] = 0, 4
        to = lambda m, extra: spark.createDataFrame([(i - 9, j - 9, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]] + extra, "i long, j long, v double")
        # An element that is 0, one that is there twice, and one that is infinite: what it doesn't meet stays finite.
        left, right = to(a, [(-6, -4, 0.0), (100, -4, float("inf")), (100, -4, 1.0)]), to(b, [(50, 51, 2.0)])
        got = {(r["i"], r["j"]): r["v"] for r in joins.matmul(left, right).collect()}
        want = left.withColumnRenamed("v", "u").alias("l").join(right.alias("r"), left["j"] == right["i"]).selectExpr("l.i", "r.j", "u * v AS v").groupBy("i", "j").sum("v").collect()
        assert repr(sorted((*k, v + 0.0) for k, v in got.items())) == repr(sorted((r[0], r[1], r[2] + 0.0) for r in want))
        plan = joins.matmul(left, right)._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" not in plan and "Broadcast" not in plan


def test_a_block_is_sent_once_to_a_tile_and_takes_few_bytes(spark, monkeypatch):
    """What a product ships: not both blocks of each pair that meets, nor twelve bytes an element."""
    from numeriq.operators import joins

    rng = np.random.default_rng(6)
    places = rng.choice(1024 * 1024, 20_000, replace=False)
    one = spark.createDataFrame([(int(p) // 1024, int(p) % 1024, 1.0) for p in places], "i long, j long, v double")
    (block,) = joins.packed(one, "b", "bk").collect()
    assert block["n"] == 20_000 and len(block["at"]) + len(block["v"]) < 2 * 20_000
    assert (np.cumsum(joins.spread(block["at"], np.int32, 20_000)) == np.sort(places)).all() and (joins.spread(block["v"], np.float64, 20_000) == 1).all()
    monkeypatch.setattr(joins, "BLOCK", 2)
    whole = spark.createDataFrame([(i, j, float(i + j)) for i in range(32) for j in range(32)], "i long, j long, v double")
    blocks = joins.cut(joins.packed(whole, "b", "bk"))
    sent = joins.tiled(blocks, blocks.selectExpr("b AS bk", "bk AS b", "n", "at", "v"))
    assert blocks.count() == 16 * 16 and sent.select("ti", "tj").distinct().count() == 16 and sent.count() == 2 * 16 * 16 * 4


def test_what_a_task_holds_of_a_matrix_and_a_vector_is_bounded(spark, monkeypatch):
    """Whatever size Spark guesses: a counted vector goes to every task, or parts of the matrix grow with its entries."""
    from numeriq.operators import estimators, factor, joins

    dense = np.array([[float((3 * i + 5 * j) % 7) for j in range(12)] for i in range(12)])
    a = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(12) for j in range(12) if dense[i, j]], "i long, j long, v double")
    b = spark.createDataFrame([(i, float(i % 7 + 1)) for i in range(12)], "i long, x double")
    y = b.select("i", joins.F.array(*["x"] * 8).alias("y"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert estimators.meet is factor.meet is joins.meet
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for sent, part in ((joins.SENT_BYTES, joins.TASK_ENTRIES), (0, 10)):
            monkeypatch.setattr(joins, "SENT_BYTES", sent)
            monkeypatch.setattr(joins, "TASK_ENTRIES", part)
            product, met = solvers.matvec(a, b), joins.meet(a, y, "i", 8)
            for found in (plan(product), plan(met)):
                if sent:
                    assert "BroadcastHashJoin" in found and "SortMergeJoin" not in found
                else:
                    assert f", {-(-a.count() // 10)})" in found and "REPARTITION_BY_NUM" in found and "Broadcast" not in found
            assert np.allclose([r["x"] for r in product.orderBy("i").collect()], dense @ (np.arange(12) % 7 + 1))
            assert sorted((r["i"], r["j"], r["v"]) for r in met.collect()) == sorted(map(tuple, a.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
