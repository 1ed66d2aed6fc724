"""The thin queries over the operators of this subpackage, one for each, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, embeddings, fingerprints, hmm, html_text, language, packing, personal_data, piece_encoding, similarity_join, spelling, token_counts, toxicity
from .common import crc_mod
from .spelling_sql import OP13
from .trie_sql import OP12

import public_tokenizers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.report(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 7) != 2).alias("train"))
    return hmm.score(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    model = language.train(docs.filter(~F.col("held_out")))
    got = language.identify(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])
    return got.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "n_langs")


def op4_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(_table(spark, sf_dir, "documents"))


def op5_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 3) == 1).alias("held_out"))
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1))
    return toxicity.score(docs, model, 0.7, keep=["doc_id", "held_out"])


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    got = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id", "n_bytes"])
    return got.withColumn("over_limit", F.col("n_tokens") > 512)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


def op9_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.similarity_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op10_cross_polytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.95)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(_table(spark, sf_dir, "documents"), personal_data.fit(personal_data.labelled_rows()))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.ordered_turns(_table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(*conversation_trie.graft(turns))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_piece_encoding, op2_hmm_language_model, op3_language_mixture, op4_bottom_k_fingerprints, op5_subword_toxicity,
                                   op6_main_text, op7_token_counts, op8_best_fit_packing, op9_signature_tree_join, op10_cross_polytope_dedup, op11_personal_data, op12_conversation_trie, op13_spelling_variants)}

#: The others can't be had in SQL as a whole; tests/llm holds them against brute force, the tokenizers' own results,
#: round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {"op12_conversation_trie": OP12, "op13_spelling_variants": OP13}
