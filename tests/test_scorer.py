"""The context scorer: its forward pass, its gradient, held-out ambiguous names, and its place in a pipeline."""

import re
import zlib

import numpy as np
import pytest
from linkloom import queries as Q
from linkloom.operators import links as L
from linkloom.operators import scorer
from linkloom.plans import processors
from linkloom.plans.builder import ConfigBuilder, Factory
from pyspark.sql import functions as F

MENTION = "text_idx long, mention_idx long, text string, label string, start int, end int, left_context string, right_context string"


def plain_score(weights, text, around, names, description):
    words = lambda s: sorted({zlib.crc32(w.encode()) for w in re.findall(r"\w+", (s or "").lower())})
    x, y = words(around), words(description)
    met = len(set(x) & set(y))
    z = weights[0] + weights[1] * (text.lower() in {n.lower() for n in names}) + weights[2] * (met > 0) + weights[3 + (10 * met // len(y) if y else 0)]
    cross = [weights[16 + (a * 31 + b * 17) % (scorer.BUCKETS - 16)] for a in x for b in y]
    return z + (sum(cross) / np.sqrt(len(cross)) if cross else 0)


def test_scores_that_only_rounding_tells_apart_are_ties(spark):
    """0.1 + 0.2 is over 0.3 in floating point: the first label counts, not the larger rest."""
    pairs = spark.createDataFrame([(0, "x", 0, 1, "first", 1, 0.3), (0, "x", 0, 1, "second", 2, 0.1 + 0.2), (1, "x", 0, 1, "first", 1, 30.0), (1, "x", 0, 1, "second", 2, 31.0)], "text_idx long, text string, start int, end int, label_text string, label_ord int, z double")
    got = L._finish(pairs.withColumn("score", 1 / (1 + F.exp(-F.col("z")))), 0.0, False, False)
    assert {r["text_idx"]: r["label"] for r in got.collect()} == {0: "first", 1: "second"}


@pytest.fixture(scope="module")
def few(spark):
    m = spark.createDataFrame([(0, 0, "Mole", None, 0, 4, "", "digs under the lawn"), (0, 1, "quay", None, 30, 34, "ships at the", "by night"), (1, 0, "mole", None, 0, 4, None, ""), (2, 0, "x", None, 0, 1, "a", "b")], MENTION)
    c = spark.createDataFrame([(t, 0, k, e, lab, al, d) for t in (0, 1) for k, (e, lab, al, d) in enumerate([("a", "mole", [], "it digs holes in a lawn"), ("b", "pier", ["Mole"], "where ships land at night"), ("c", "quay", None, None)])],
                              "text_idx long, mention_idx int, cand_ord int, entity_id string, label string, aliases array<string>, description string")
    c = c.withColumn("popularity", F.lit(0)).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("embedding_model_id", F.lit(None).cast("string"))
    return m, L.labels(c, "{entity_id}"), {r["entity_id"]: (r["label"], r["aliases"] or [], r["description"]) for r in c.collect()}


def test_scores_and_links(few):
    m, rows, told = few
    weights = np.random.default_rng(4).normal(size=scorer.BUCKETS)
    around = {(r["text_idx"], r["start"]): (r["text"], f"{r['left_context'] or ''} {r['right_context'] or ''}") for r in m.collect()}
    got = scorer.scored(scorer.context_pairs(m, rows), weights).collect()
    assert len(got) == 9
    want = {}
    for r in got:
        label, aliases, about = told[r["entity_id"]]
        text, near = around[r["text_idx"], r["start"]]
        want[r["text_idx"], r["start"], r["label_text"]] = p = 1 / (1 + np.exp(-plain_score(weights, text, near, [label, *aliases], about)))
        assert np.isclose(r["score"], p)
    for r in scorer.context_links(m, rows, weights, 0.0, flat=False).collect():
        mine = {k[2]: v for k, v in want.items() if k[:2] == (r["text_idx"], r["start"])}
        assert r["label"] == max(mine, key=mine.get) and {k: round(v, 9) for k, v in r["class_probs"].items()} == {k: round(v, 9) for k, v in mine.items()}


def test_a_round_follows_the_gradient(few):
    """The first step of each weight has the sign of the likelihood's slope, taken by small differences."""
    m, rows, _ = few
    pairs = scorer.context_pairs(m, rows).withColumn("right", (F.col("entity_id") == "a") & (F.col("start") == 0) | (F.col("entity_id") == "c") & (F.col("start") == 30))
    weights = scorer.train(pairs, rounds=1, rate=1.0)
    rows_ = pairs.collect()
    n, k = len(rows_), sum(r["right"] for r in rows_)

    def loss(w):
        ps = {(r["text_idx"], r["start"], r["entity_id"]): r["score"] for r in scorer.scored(pairs, w).collect()}
        return sum((0.5 / k if r["right"] else 0.5 / (n - k)) * np.log(p if r["right"] else 1 - p) for r in rows_ for p in [ps[r["text_idx"], r["start"], r["entity_id"]]])

    for f in [0, 1, 2, *np.flatnonzero(weights)[-3:].tolist()]:
        d = np.zeros(scorer.BUCKETS)
        d[f] = 1e-5
        slope = loss(d) - loss(-d)
        assert np.isclose(np.sign(weights[f]), np.sign(round(slope, 12)))
    assert not scorer.train(pairs.limit(0)).any()


def test_ambiguous_names_that_training_did_not_see(spark):
    """Names that texts of several languages share: names and edit similarity can't tell the senses apart."""
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    m, c = Q.sense_pairs(table, 40)
    docs = table("documents").select(F.col("doc_id").alias("doc"), "lang")
    rows = L.labels(c, "{entity_type}")
    told = m.withColumn("doc", F.floor(F.col("text_idx") / 1_000_000)).join(docs, "doc").select("text_idx", "lang", (F.crc32(F.lower("text").cast("binary")) % 4 == 0).alias("held_out"))
    pairs = scorer.context_pairs(m, rows).join(told, "text_idx").withColumn("right", F.col("label_text") == F.col("lang")).persist()
    weights = scorer.train(pairs.filter("not held_out"))
    test = told.filter("held_out")
    n = test.count()

    def right(links):
        return links.join(test, "text_idx").filter("label = lang").count() / n

    by_context, by_name = right(scorer.context_links(m, rows, weights, 0.0, flat=False)), right(L.lexical(m, rows, 0.0, flat=False))
    assert n > 100 and by_context > 0.9 and by_context > by_name + 0.15, (n, by_context, by_name)


def test_a_pipeline_links_by_context(spark):
    texts = spark.createDataFrame([(0, "the mole digs under our lawn"), (1, "ships land at the mole tonight")], "text_idx long, text string")
    given = spark.createDataFrame([(0, 0, "mole", None, 4, 8, "the", "digs under our lawn"), (1, 0, "mole", None, 18, 22, "ships land at the", "tonight")], MENTION)
    recs = [dict(entity_id="animal", label="mole", description="digs holes in a lawn", popularity=1), dict(entity_id="pier", label="breakwater", aliases=["mole"], description="where ships land", popularity=1)]
    weights = np.zeros(scorer.BUCKETS)
    weights[3:14] = np.arange(11) / 2
    processors.SCORERS["by-context"] = weights
    try:
        b = ConfigBuilder("context").set_schema_template("{label}: {description}")
        b.l2.add("dict").l3.configure(model="by-context", threshold=0.5)
        ex = Factory.create_from_dict(b.build(), spark)
        ex.load_entities(recs)
        out = ex.execute({"texts": texts, "entities": given}).get("l0_result").collect()
    finally:
        del processors.SCORERS["by-context"]
    assert {r["text_idx"]: r["entity_id"] for r in out} == {0: "animal", 1: "pier"}
