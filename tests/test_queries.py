"""Registered queries over tables whose ids go beyond the given small ones."""

from linkloom import queries as Q


def test_update_embeddings_applies_every_vector(spark, tmp_path):
    spark.range(1, 701).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(650).selectExpr("id AS vec_id", "array(1.0f, 2.0f) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {int(r["entity_id"]): r["embedding_model_id"] for r in Q.QUERIES["kb_update_embeddings"](spark, str(tmp_path)).collect()}
    assert got == {k: "m2" if k <= 650 else None for k in range(1, 701)}


def test_candidate_scores_of_all_mentions_by_both_passes(spark, tmp_path):
    texts = ["River then Stone"] * 6 + ["River, Riverside and Stone or Millstone"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["text_idx"], r["start_pos"]): (r["entity_id"], r["p"]) for r in Q.QUERIES["l0_candidate_scores"](spark, str(tmp_path)).collect()}
    # Millstone has no record and holds `stone` as it is written in lower case; the same for Riverside and `river`.
    want = {(6, 0): ("T:river", 0.0), (6, 7): ("T:river", 0.2), (6, 21): ("T:stone", 0.4), (6, 30): ("T:stone", 0.6)}
    assert got == want | {(i, at): (e, p) for i in range(6) for at, e, p in ((0, "T:river", 0.0), (11, "T:stone", 0.2))}
