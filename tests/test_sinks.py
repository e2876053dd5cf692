import struct

from numeriq.sources import tables


def test_centres_come_back(spark, tmp_path):
    rows = [(7, 2.5, [1.0, -0.25]), (3, 10.0, [0.5, 3.125]), (12, 1.0, [0.0, 100.0])]
    df = spark.createDataFrame(rows, "id long, weight double, v array<double>").repartition(2)
    tables.write_weighted_centres(df, str(tmp_path / "c"))
    assert sorted(map(tuple, tables.read_weighted_centres(spark, str(tmp_path / "c")).collect())) == sorted(rows)
    text = "".join(open(f).read() for f in sorted((tmp_path / "c").glob("part-*")))
    assert text.startswith("3\n10.000000\n0.500000 3.125000 \n\n7\n2.500000\n")
    tables.write_centroids(df.withColumnRenamed("id", "centre"), str(tmp_path / "k"))
    back = spark.read.csv(str(tmp_path / "k"), header=True, inferSchema=True)
    assert back.columns == ["centroid_index", "feature_0", "feature_1"] and sorted(map(tuple, back.collect())) == sorted((i, *v) for i, _, v in rows)


def test_tails_of_binary_files_are_told(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "whole.bin").write_bytes(struct.pack("<6f", *range(6)))
    (tmp_path / "b" / "odd.bin").write_bytes(struct.pack("<3f", 9, 8, 7) + b"xy")
    got = {r["file"].rsplit("/", 1)[1]: (r["points"], r["tail"]) for r in tables.float_block_tails(spark, str(tmp_path / "b"), 2).collect()}
    assert got == {"whole.bin": (3, 0), "odd.bin": (1, 6)}
    assert sorted(list(r["v"]) for r in tables.read_float_blocks(spark, str(tmp_path / "b"), 2).collect()) == [[0, 1], [2, 3], [4, 5], [9, 8]]


def test_summaries_of_folders(spark, tmp_path):
    from numeriq.plans import tuner

    for name, lines in (("cg", ["1,3,0", "2,2,1"]), ("knn a", ["1,0,4"])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "counts.csv").write_text("\n".join(["Digits,FP64,FP32", *lines]))
    got = tuner.folder_summary(spark, f"{tmp_path}/*/counts.csv", "Digits int, FP64 int, FP32 int")
    assert got.columns[0] == "Folder" and sorted(map(tuple, got.collect())) == [("cg", 1, 3, 0), ("cg", 2, 2, 1), ("knn a", 1, 0, 4)]
    counts = spark.createDataFrame([(1, "d", 3), (1, "s", 2), (2, "s", 5)], "digits int, format string, n long")
    assert sorted(map(tuple, tuner.counts_by_format(counts, ["d", "s", "b"]).collect())) == [(1, 3, 2, 0), (2, 0, 5, 0)]


def test_splines_at_any_place(spark):
    from numeriq.operators import series

    knots = spark.createDataFrame([("a", float(x), float(x**3 - 2 * x)) for x in range(6)] + [("b", 1.0, 5.0)], "g string, x double, y double")
    points = spark.createDataFrame([("a", t) for t in (-0.5, 0.0, 0.25, 2.0, 4.75, 5.0, 5.1)] + [("b", 1.0), ("c", 2.0)], "g string, t double")
    got = {(r["g"], r["t"]): r["value"] for r in series.spline_at(knots, points, ["g"], "x", "y", "t").collect()}
    assert [got["a", t] for t in (-0.5, 5.1)] == [None, None] and got["b", 1.0] is None and got["c", 2.0] is None
    assert abs(got["a", 0.0]) < 1e-12 and abs(got["a", 2.0] - 4) < 1e-12 and abs(got["a", 5.0] - 115) < 1e-12
    # Natural ends, so only near what the cubic gives.
    assert abs(got["a", 0.25] - (0.25**3 - 0.5)) < 0.5 and abs(got["a", 4.75] - (4.75**3 - 9.5)) < 4


def test_rows_that_first_reach_a_level(spark):
    from numeriq.operators import sequences

    rows = [("a", 1, 0.2), ("a", 2, 0.5), ("a", 3, 0.5), ("a", 4, 1.0), ("b", 1, 1.0), ("c", 1, 0.1)]
    df = spark.createDataFrame(rows, "g string, t int, cdf double")
    got = {(r["g"], r["u"]): r["t"] for r in sequences.first_reaching(df, ["g"], ["t"], "cdf", [0.0, 0.25, 0.5, 0.75]).collect()}
    assert got == {("a", 0.0): 1, ("a", 0.25): 2, ("a", 0.5): 2, ("a", 0.75): 4, ("b", 0.0): 1, ("b", 0.25): 1, ("b", 0.5): 1, ("b", 0.75): 1, ("c", 0.0): 1}


def test_intermediate_tables_are_deleted_on_demand(spark):
    from numeriq.plans.lineage import cut, discard

    discard(spark)
    kept = [cut(spark.range(n)) for n in (3, 4)]
    paths = [p for df in kept for p in df.inputFiles()]
    assert kept[1].count() == 4 and discard(spark) == 2 and discard(spark) == 0
    import os
    from urllib.parse import urlparse

    assert not any(os.path.exists(urlparse(p).path) for p in paths)
