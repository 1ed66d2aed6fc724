"""What each stage of the pipeline keeps, against brute force over all its rows."""

from functools import cache

import corpus_pipeline as P
import numpy as np
from linkloom.llm import common, toxicity

SMALL = "/root/testdata/sf0.001"


def kept(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def smallest_of_each_group(rows, words=5, percent=80):
    """Ids that no smaller id is linked to, over any number of links."""
    sets = {}
    for d, t in rows:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i: i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    group = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return [d for d in ids if group[d] == d]


def test_each_stage_keeps_exactly_what_brute_force_keeps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    long = " ".join(f"clear{i} water" for i in range(40))
    extra = [(900_001, None), (900_002, ""), (900_003, "12 + 30 = 42 !!"), (900_004, long), (900_005, long + " end"), (900_006, "日本語"), (900_007, long.upper())]
    rows = spark.createDataFrame([(d, t, "en", "made", len(t or "")) for d, t in extra], "doc_id long, text string, lang string, source string, n_chars long")
    docs = common.write_table(docs.unionByName(rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in docs.schema.fields])), "docs")
    stages, text = dict(P.STAGES), lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    lettered = common.write_table(stages["language_id"](spark, docs, SMALL), "lettered")
    assert kept(lettered) == sorted(d for d, t in text(docs) if any(c.isalpha() for c in t or ""))

    model = toxicity.fit(lettered, spark.read.parquet(f"{SMALL}/labels.parquet"))
    margin = cache(lambda w: float(toxicity.word_margins([w], model["vectors"])[0]))

    def score(t):
        ws = t.encode().lower().split()
        return 1 / (1 + np.exp(-(sum(map(margin, ws)) / max(1.0, (toxicity.EVEN * len(ws)) ** 0.5) + model["bias"])))

    clean = common.write_table(stages["toxicity"](spark, lettered, SMALL), "clean")
    want = sorted(d for d, t in text(lettered) if score(t) < 0.7)
    assert kept(clean) == want and len(want) < lettered.count()

    unlike = stages["near_duplicates"](spark, clean, SMALL)
    want = smallest_of_each_group(text(clean))
    assert kept(unlike) == want and len(want) < clean.count()


def test_stages_on_odd_rows(spark, odd):
    stages, docs = dict(P.STAGES), odd.select(P.COLUMNS)
    ids = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in df.select("doc_id").collect())
    lettered = stages["language_id"](spark, docs, SMALL)
    assert ids(lettered) == [-1, 4, 5, 5, 6, 7, 8, 9] and lettered.columns == P.COLUMNS
    assert set(ids(stages["toxicity"](spark, docs, SMALL))) <= set(ids(docs))
    assert ids(stages["near_duplicates"](spark, docs, SMALL)) == [-1, 1, 2, 3, 4, 5, 7, 9]
    packed = stages["packing"](spark, docs, SMALL).filter("piece = 0")
    assert ids(packed) == ids(docs)
    twice = spark.createDataFrame([(5, "a b c d e f", "en", "s", 0), (5, "u v w x y z", "en", "s", 0), (5, "a b c d e f", "en", "s", 0), (3, "u v w x y z", "en", "s", 0)], docs.schema)
    assert sorted((r["doc_id"], r["text"][0]) for r in stages["near_duplicates"](spark, twice, SMALL).collect()) == [(3, "u"), (5, "a"), (5, "u")]


def test_stages_on_an_empty_table(spark, none):
    at = none.select(P.COLUMNS)
    for name, stage in P.STAGES[:-1]:
        at = common.write_table(stage(spark, at, SMALL), name)
        assert at.count() == 0 and at.columns == P.COLUMNS
    assert P.STAGES[-1][1](spark, at, SMALL).count() == 0
