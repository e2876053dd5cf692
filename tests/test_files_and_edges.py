"""Cases that plain inputs don't show: lines that look alike, gaps, wide keys."""

from numeriq.operators import joins, prep
from numeriq.plans.tuner import split_parts
from numeriq.sources import tables
from numeriq.streaming import streams


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_matrix_files(spark, tmp_path):
    mtx = tmp_path / "a.mtx"
    mtx.write_text("%%MatrixMarket matrix coordinate real general\n% note\n3 3 4\n1 1 2.5\n3 3 4\n2 1 1\n3 2 -1\n")
    a = tables.read_matrix_market(spark, str(mtx))
    assert rows(a) == [(0, 0, 2.5), (1, 0, 1.0), (2, 1, -1.0), (2, 2, 4.0)]
    out = str(tmp_path / "m")
    tables.write_matrix(a, out, (4, 3))
    lines = [r[0] for r in spark.read.text(out).collect()]
    assert sorted(lines) == sorted(["2.5,0.0,0.0", "1.0,0.0,0.0", "0.0,-1.0,4.0", "0.0,0.0,0.0"])
    dense = tmp_path / "d.csv"
    dense.write_text("a,b\n1,2\n3,4\n")
    assert rows(tables.read_matrix(spark, str(dense), header=True)) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]


def test_settings_are_read_as_written(spark, tmp_path):
    df = spark.createDataFrame([(2, {"s": ["x"]}), (1, {"d": ["x", "y"], "s": []})], "digits int, settings map<string,array<string>>")
    tables.write_settings(df, str(tmp_path / "s"))
    assert sorted((r["digits"], r["settings"]) for r in tables.read_settings(spark, str(tmp_path / "s")).collect()) == [(1, {"d": ["x", "y"], "s": []}), (2, {"s": ["x"]})]


def test_wide_and_narrow_keys(spark):
    for kind, key in (("int", 10), ("long", 10**11), ("long", -(2**62))):
        assert prep.hash_split(spark.createDataFrame([(key,)], f"k {kind}"), "k").first()["train"] in (True, False)


def test_stencil_knows_gaps(spark):
    g = spark.createDataFrame([(0, 0, 1.0), (0, 5, 2.0), (1, 0, 3.0)], "r long, c long, v double")
    assert rows(joins.stencil(g).select("r", "c", "n", "s", "w", "e")) == [(0, 0, 1.0, 3.0, 1.0, 1.0), (0, 5, 2.0, 2.0, 2.0, 2.0), (1, 0, 1.0, 3.0, 3.0, 3.0)]


def test_streams_end_and_take_text_keys(spark):
    seen = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "k string, t long, x double")
    assert streams.particle_filter(seen, "k", "t", "x", particles=8).count() == 5


def test_parts():
    assert split_parts([1, 2, 3, 4, 5, 6, 7], 3) == [[1, 2], [3, 4], [5, 6, 7]] and split_parts([1, 2, 3, 4, 5], 3) == [[1], [2, 3], [4, 5]] and split_parts([], 2) == [[], []]
