import importlib

from test_ngram import brute

from numeriq.llm.common import materialize
from numeriq.llm.toxicity import toxicity_scores

import corpus_pipeline


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    bad = {r["doc_id"] for r in toxicity_scores(docs, labels).collect() if r["predicted"]}
    stay = {i: t for i, t in rows.items() if i not in bad}
    now = docs
    steps = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = materialize(stage(spark, now, sf_dir), "test")
        assert now.columns == docs.columns
        steps.append({r["doc_id"]: r["text"] for r in now.collect()})
    assert steps[0] == stay
    last = {}
    for i in sorted(stay):
        last[stay[i].encode().lower()] = i
    stay = {i: stay[i] for i in last.values()}
    assert steps[1] == stay
    keep = {eval(x)[1] for x in brute(list(stay.items()))}
    assert set(steps[2]) == keep
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == keep


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_rows_that_share_an_id_are_told_apart(spark):
    df = spark.createDataFrame([(1, "Same text here for all of us now"), (1, "another one entirely, that is kept as it is"), (2, "same text here for all of us now"), (None, "same text here FOR all of us now"), (None, "no id but own text is kept here")], "doc_id long, text string")
    for f in (corpus_pipeline.exact_dedup, corpus_pipeline.ngram_jaccard_join):
        got = f(spark, df, "").collect()
        assert len(got) == 3 and len({r["text"].lower() for r in got}) == 3


def test_clashing_names_nulls_and_empty_tables(spark, tmp_path):
    from numeriq.llm.exact_dedup import deduplicate
    from numeriq.llm.ngram_join import keep_one

    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, None, "a"), (None, "", "b"), (1, words, "c"), (2, words, "d"), (3, words + " more", "e"), (4, "short", "f")]
    docs = spark.createDataFrame([(*r, 7, "y", 1, "z") for r in rows], "doc_id long, text string, lang string, __id int, __RAW string, __id_ int, raw string")
    once = deduplicate(docs)
    assert once.columns == docs.columns and sorted(str(r["doc_id"]) for r in once.collect()) == ["2", "3", "4", "None", "None"]
    assert sorted(str(r["doc_id"]) for r in keep_one(once).collect()) in (["2", "4", "None", "None"], ["3", "4", "None", "None"])
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
