"""Searches and joins of spans against everything with everything."""

import random

from linkloom.functions import similarity as S
from linkloom.operators import candidates as C
from linkloom.operators import mentions as M
from pyspark.sql import functions as F


def distance(a, b):
    """Edits and swaps by the whole table."""
    t = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i, j] = min(t[i - 1, j] + 1, t[i, j - 1] + 1, t[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                t[i, j] = min(t[i, j], t[i - 2, j - 2] + 1)
    return t[len(a), len(b)]


def test_near_strings_share_a_deletion(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(0, 22))) for _ in range(40)]
    words = {""}
    for w in base:
        words.add(w)
        for _ in range(4):
            x = list(w)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(x) + 1)
                what = rng.randrange(3)
                if what == 0:
                    x.insert(i, rng.choice("abcé"))
                elif what == 1 and i < len(x):
                    del x[i]
                elif i + 1 < len(x):
                    x[i], x[i + 1] = x[i + 1], x[i]
            words.add("".join(x))
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for most, keep in ((1, 0), (2, 1), (2, 0)):
        side = lambda c: df.select(F.col("w").alias(c), F.substring("w", 1, keep).alias("p"), F.explode(S.deletions(F.col("w"), most, keep)).alias("g"))  # noqa: B023, E731
        got = side("a").join(side("b"), ["p", "g"]).select("a", "b").distinct().withColumn("d", S.edit_distance(F.col("a"), F.col("b"), most)).filter(F.col("d") <= most)
        want = {(a, b, d) for a in words for b in words if a[:keep] == b[:keep] and abs(len(a) - len(b)) <= most for d in [distance(a, b)] if d <= most}
        assert {tuple(r) for r in got.collect()} == want


def test_spans_that_overlap_nothing(spark):
    rng = random.Random(7)
    span = lambda: (lambda a: (a, a + rng.choice([0, 1, 3, 9, 40, 300])))(rng.randrange(-5, 600))
    mine = [(t, k, *span()) for t in range(12) for k in range(rng.randrange(0, 12))]
    more = [(t, k, *span()) for t in range(14) for k in range(30)]
    schema = "text_idx long, mention_idx long, start int, end int"
    for width in (64, 7):
        got = M.free_of(spark.createDataFrame(more, schema), spark.createDataFrame(mine, schema), width)
        want = [x for x in more if not any(x[0] == m[0] and not (x[3] <= m[2] or x[2] >= m[3]) for m in mine)]
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_a_text_of_many_spans(spark):
    """50,000 spans of one text, against as many and one over all of them: pairs stay few."""
    n = 50_000
    a = spark.range(n).selectExpr("0L AS text_idx", "id AS mention_idx", "CAST(id * 4 AS INT) AS start", "CAST(id * 4 + 2 AS INT) AS end")
    b = spark.range(n).selectExpr("0L AS text_idx", "id AS mention_idx", "CAST(id * 4 + 2 + id % 2 AS INT) AS start", "CAST(id * 4 + 5 - id % 2 AS INT) AS end")
    assert M.free_of(b, a).count() == n // 2 + 0
    whole = spark.createDataFrame([(0, 0, 0, 4 * n + 9)], "text_idx long, mention_idx long, start int, end int")
    assert M.free_of(b, whole).count() == 0


def test_copies_of_a_record_are_scored_once(spark, monkeypatch):
    """Entities of the same fields share their score, count each in the statistics, and come by their ids."""
    kinds = [("red lamp", ["lamp"], "a lamp of glass"), ("red chair", [], "wood"), ("blue lamp", None, None)]
    rows = [(f"{i:03d}", *kinds[i % 2 if i else 2]) for i in range(150)]
    records = spark.createDataFrame(rows, "entity_id string, label string, aliases array<string>, description string")
    seen, plain = [], C.postings
    monkeypatch.setattr(C, "postings", lambda r: (seen.append(r.select("entity_id").distinct().count()), plain(r))[1])
    got = {}
    for r in C.full_text(spark.createDataFrame([("red lamp",), ("blue",), ("chair wood",)], "q string"), records).orderBy("q", "ord").collect():
        got.setdefault(r["q"], []).append(r["entity_id"])
    lamps, chairs = [f"{i:03d}" for i in range(2, 150, 2)], [f"{i:03d}" for i in range(1, 150, 2)]
    assert got == {"red lamp": lamps[:50], "blue": ["000"], "chair wood": chairs[:50]}
    assert seen == [3]
