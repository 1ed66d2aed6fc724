"""A corpus pipeline of four stages over `documents`: language ID, toxicity, near duplicates and packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import language, packing, similarity_join, toxicity
from linkloom.llm.common import write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _kept(docs: DataFrame) -> DataFrame:
    return docs.select([c for c in COLUMNS if c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts and texts without a letter (`und`). Rows that repeat an id are
    judged each by its text; an empty table stays empty."""
    model = language.train(docs)
    return _kept(language.identify(docs, model).filter(F.col("lang_pred") != language.UNKNOWN))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score 0.7 or more, by a model of the labels of the documents that are here. Rows that repeat
    an id are judged each by its text; without labels nothing goes."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(toxicity.score(docs, model, 0.7).filter("predicted = 0"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group linked by a Jaccard likeness of 0.8 or more of
    five-word shingles. A document without an id is kept. Of rows that repeat an id and a text one stays; an id of
    several texts stays with all of them if it is the smallest of one's group."""
    comp = similarity_join.similarity_components(docs, words=5, percent=80)
    keep = comp.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(keep, "doc_id", "left_semi").withColumn("_text", F.md5(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return _kept(named.unionByName(docs.filter("doc_id is null")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents that are left into sequences of at most 2048 tokens; rows that repeat an id are packed each."""
    return packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The stages are models and searches that SQL doesn't express; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return write_table(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
