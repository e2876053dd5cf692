"""From documents to training sequences: reject toxic documents, drop exact copies, keep one document of each near-duplicate group, pack.

Stages but the last return the columns of documents, whatever further ones there are and whatever their names. Null and empty texts are alike: they are scored
like any other, and are copies of each other. Of equal texts the largest doc_id stays, a null one last; rows of one doc_id and text share their fate, and rows
of one doc_id with different texts are told apart. Which of several near duplicates stays is said in the stage's operator. Without documents there are no
pieces; without labels nothing is rejected. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from numeriq.llm.common import materialize, table
from numeriq.llm.exact_dedup import deduplicate
from numeriq.llm.ngram_join import keep_one
from numeriq.llm.packing import pack_documents
from numeriq.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


#: Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the docs of the next.
STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("n-gram Jaccard join", ngram_jaccard_join), ("best-fit packing", best_fit_packing)]

#: A nearest-neighbour score and a tokenizer can't be written as SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
