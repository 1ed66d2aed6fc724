"""Golden cases of retrieval, links and aggregation."""

import random

import pytest
import regex
from linkloom.functions import similarity as S
from linkloom.operators import aggregate as A
from linkloom.operators import candidates as C
from linkloom.operators import gazetteer as G
from linkloom.operators import links as L
from linkloom.operators import mentions as M
from linkloom.sources import kb, stores
from linkloom.streaming import linking
from pyspark.sql import functions as F

# Two entities of one name and rank, an alias that two share, names that end in signs, lie in each other or are long.
RECORDS = [
    dict(entity_id="town", label="Port Ellory", aliases=["Ellory"], description="harbour on the north coast", popularity=40),
    dict(entity_id="wine", label="Port Ellory", aliases=["the tawny of the old cellars above the quay"], description="fortified wine", popularity=40),
    dict(entity_id="lang", label="Q++", aliases=[], popularity=12),
    dict(entity_id="lib", label="Q++ Toolkit", aliases=["toolkit", "QT++"], description="parts for Q++", popularity=7),
    dict(entity_id="box", label="tool chest", aliases=["Toolkit"], popularity=7, id="c", name="chest"),
    dict(entity_id="nil", label="0", aliases=["zero", "nought", "zero"], popularity=0),
    dict(entity_id="saw", label="Trestle"),
]
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
CAND = "text_idx long, mention_idx long, cand_ord int, entity_id string, label string, aliases array<string>, description string, popularity long"
LINK = "text_idx long, link_ord long, text string, label string, start int, end int, score double, class_probs map<string,double>"
MENTION = "text_idx long, mention_idx long, text string, label string, start int, end int, left_context string, right_context string"


@pytest.fixture(scope="module")
def records(spark):
    return kb.read_records(spark, RECORDS).persist()


def found(spark, search, qs):
    out = search(spark.createDataFrame([(q.lower(),) for q in qs], "q string")).collect()
    return {q: [r["entity_id"] for r in sorted(out, key=lambda r: r["ord"]) if r["q"] == q.lower()] for q in qs}


def test_exact(spark, records):
    """Of entities of one label that of the last load, of an alias's all in the order of their load."""
    got = found(spark, lambda q: C.exact(q, records), ["port ELLORY", "ellory", "q++", "Toolkit", "zero", "q+", ""])
    assert got == {"port ELLORY": ["wine"], "ellory": ["town"], "q++": ["lang"], "Toolkit": ["lib", "box"], "zero": ["nil"], "q+": [], "": []}


def test_fuzzy(spark, records):
    """An alias counts only where the label begins as the query does: `tolkit` isn't a name of Q++ Toolkit here."""
    got = found(spark, lambda q: C.fuzzy(q, records, 0.7, 1), ["port elory", "tolkit", "qt+", "q++ tolkit", "trestles", "naught", "zer"])
    assert got == {"port elory": ["town", "wine"], "tolkit": ["box"], "qt+": ["lib"], "q++ tolkit": ["lib"], "trestles": ["saw"], "naught": [], "zer": []}


def edit_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def test_searches_lose_nothing(spark):
    """Fuzzy, trigram and substring search against every pair of query and record."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
    rows = [dict(entity_id=str(i), label=" ".join(word() for _ in range(rng.randrange(1, 3))), aliases=[word() for _ in range(rng.randrange(0, 3))], popularity=i % 5) for i in range(80)]
    recs, qs = kb.read_records(spark, rows).persist(), sorted({word() + " " * (i % 3 == 0) + word() for i in range(60)})
    ids = lambda search: {q: sorted(v) for q, v in found(spark, search, qs).items()}
    grams = lambda s: {p[i: i + 3] for w in s.split() for p in [f"  {w} "] for i in range(len(p) - 2)}
    for least in (0.5, 0.75, 1.0):
        near = lambda q, r: (r["label"][0] == q[0]) and (edit_ratio(q, r["label"]) >= least or any(a[0] == q[0] and edit_ratio(q, a) >= least for a in r["aliases"]))  # noqa: B023, E731
        assert ids(lambda q: C.fuzzy(q, recs, least, 1)) == {q: sorted(r["entity_id"] for r in rows if near(q, r)) for q in qs}  # noqa: B023
    for least in (0.2, 0.3, 0.6):
        alike = lambda q, r: len(grams(q) & grams(r["label"])) / len(grams(q) | grams(r["label"])) >= least  # noqa: B023, E731
        assert ids(lambda q: C.trigram(q, recs, least, 1000)) == {q: sorted(r["entity_id"] for r in rows if alike(q, r)) for q in qs}  # noqa: B023
    assert ids(lambda q: C.contains(q, recs, 1000)) == {q: sorted(r["entity_id"] for r in rows if any(q in x for x in [r["label"], *r["aliases"]])) for q in qs}


def test_candidates(spark, records):
    texts = spark.createDataFrame([(0, "From Port Ellory, a toolkit (Q++ toolkit) for q++ came; Q++x and preport ellory didn't."), (1, ""), (2, None)], "text_idx long, text string")
    m = G.gazetteer_mentions(texts, kb.surface_forms(records))
    got = [(r["text"], r["start"]) for r in m.orderBy("start", "end").collect()]
    assert got == [("Port Ellory", 5), ("Ellory", 10), ("toolkit", 20), ("Q++", 29), ("Q++ toolkit", 29), ("toolkit", 33), ("q++", 46), ("Q++", 56), ("ellory", 73)]
    chain = kb.Chain([kb.Layer("d", "dict", search_mode=["exact", "fuzzy"], fuzzy={"min_similarity": 0.7, "prefix_length": 1})])
    assert chain.load(records) == {"dict": 7} and chain.load(records) == {"dict": 0}
    c = C.candidates(m.filter("mention_idx in (0, 2, 3)"), chain, 5, 0)
    assert [(r["mention_idx"], r["entity_id"]) for r in c.orderBy("mention_idx", "cand_ord").collect()] == [(0, "wine"), (0, "town"), (2, "lib"), (2, "box"), (3, "lang"), (3, "lib")]


def plain_places(text, names):
    out = []
    for n in {n.lower() for n in names if n}:
        for m in regex.finditer(regex.escape(n), text.lower(), overlapped=True):
            s, e = m.span()
            if not (s and text[s].isalnum() and text[s - 1].isalnum()) and not (e < len(text) and text[e - 1].isalnum() and text[e].isalnum()):
                out.append((s, e))
    return sorted(out)


@pytest.mark.parametrize("most", [10**6, 0])
def test_names_by_automaton_and_by_joins(spark, most):
    """Both ways of the gazetteer against every name at every place; names of 1 to 12 words, with signs anywhere."""
    rng = random.Random(12)
    word = lambda: rng.choice(["ab", "abc", "b", "c++", "+x", "é", "日本", "a-b", "7", "(b", "c."])
    names = [" ".join(word() for _ in range(rng.randrange(1, 13) if i % 4 == 0 else rng.randrange(1, 3))) for i in range(60)] + ["", "AB"]
    texts = [" ".join(rng.choice(names) if rng.random() < 0.3 else word() for _ in range(rng.randrange(0, 30))).swapcase() for _ in range(50)] + ["", None, "ab" * 50]
    df, keys = spark.createDataFrame(list(enumerate(texts)), "text_idx long, text string"), spark.createDataFrame([(n,) for n in names], "key string")
    got = G.gazetteer_mentions(df, keys, 5, 5, most, most).collect()
    assert sorted((r["text_idx"], r["start"], r["end"]) for r in got) == [(i, *x) for i, t in enumerate(texts) for x in plain_places(t or "", names)]
    for r in got:
        t = texts[r["text_idx"]]
        assert r["text"] == t[r["start"]: r["end"]] and r["left_context"] == t[max(0, r["start"] - 5): r["start"]].strip() and r["right_context"] == t[r["end"]: r["end"] + 5].strip()
    assert G.gazetteer_mentions(df, keys.limit(0), most_names=most).count() == 0


def test_shared_candidates(spark, records):
    """Flat and overlapping links, one or several to a span, and their ranking by what the candidates hold."""
    texts = spark.createDataFrame([(0, "Port Ellory sells a Q++ Toolkit"), (1, "nothing")], "text_idx long, text string")
    c = C.all_entities(records)
    links = lambda **kw: [(r["text"], r["label"]) for r in L.shared_links(texts, c, **kw).orderBy("link_ord").collect()]
    assert links() == [("Port Ellory", "Port Ellory"), ("Q++ Toolkit", "Q++ Toolkit")]
    assert links(flat=False) == [("Port Ellory", "Port Ellory"), ("Ellory", "Port Ellory"), ("Q++", "Q++"), ("Q++ Toolkit", "Q++ Toolkit"), ("Toolkit", "Q++ Toolkit")]
    assert links(text="{label}: {description}", multi_label=True) == [("Port Ellory", "Port Ellory: harbour on the north coast"), ("Port Ellory", "Port Ellory: fortified wine"), ("Q++ Toolkit", "Q++ Toolkit: parts for Q++")]
    assert links(threshold=1.5) == []
    rich = c.withColumn("popularity", F.col("popularity") * 25_000)
    got = L.rank(L.shared_links(texts, rich), rich, [("gliner_score", 0.5), ("popularity", 0.5)], shared=True).orderBy("link_ord").collect()
    assert [(r["label"], round(r["score"], 6)) for r in got] == [("Port Ellory", 1.0), ("Q++ Toolkit", 0.5875)]


@pytest.mark.parametrize("kind, ttl, later", [("dict", 0, "up"), ("elasticsearch", 0, "up"), ("redis", 60, "up"), ("redis", 0, "down")])
def test_answers_serve_the_next_search(spark, records, kind, ttl, later):
    chain = kb.Chain([kb.Layer("up", kind, 2, True, ["exact"], ttl), kb.Layer("down", "dict", 1, False, ["exact"])])
    chain.load(records, ["down"])
    m = spark.createDataFrame([(0, 0, "nought"), (0, 1, "TRESTLE"), (0, 2, "nothing")], "text_idx long, mention_idx long, text string")
    first, again = ([(r["mention_idx"], r["entity_id"], r["label"], r["hit_layer"]) for r in C.candidates(m, chain, 5, 0, cache=True).orderBy("mention_idx").collect()] for _ in range(2))
    assert first == [(0, "nil", "0", "down"), (1, "saw", "Trestle", "down")]
    assert again == [(0, "nil", "0", later), (1, "saw", "Trestle", later)]


def test_plans_dont_grow_with_answers(spark, records):
    """Records are written after each change: the twentieth search plans as much as the second."""
    m = spark.createDataFrame([(0, 0, "nought"), (0, 1, "trestle")], "text_idx long, mention_idx long, text string")
    for kind, ttl in (("dict", 0), ("redis", 60)):
        chain = kb.Chain([kb.Layer("up", kind, 2, True, ["exact"], ttl), kb.Layer("down", "dict", 1, False, ["exact"])])
        chain.load(records, ["down"])
        sizes = []
        for _ in range(6):
            C.candidates(m, chain, 5, 0, cache=True)
            up = chain.get_layer("up")
            sizes.append(len((up.records if kind == "dict" else up.cached)._jdf.queryExecution().logical().toString()))
        assert sizes[-1] == sizes[1]


def test_stores_keep_the_mapped_fields(spark, records):
    x = kb.Layer("rel", "postgres", field_mapping={"entity_id": "id", "label": "name"})
    x.load(records)
    r = x.records.filter("entity_id = 'wine'").first()
    assert (r["label"], r["aliases"], r["description"], r["popularity"], r["source"]) == ("Port Ellory", [], "", 0, "postgres")


def test_store_that_cant_be_reached(spark):
    x = kb.Layer("rel", "postgres", config={"url": "jdbc:none://nowhere/x"})
    stores.connect(spark, x)
    assert not x.available and kb.Chain([x]).usable() == []


def test_vectors_and_layers(spark, records):
    chain = kb.Chain([kb.Layer("d", "dict"), kb.Layer("bare", "postgres", records=records.drop("description"))])
    chain.load(records, ["dict"])
    encode = lambda c: F.array(F.length(c).cast("float"))
    assert chain.precompute(encode, "{label} ({description})", "m") == {"dict": 7, "postgres": 0}
    assert chain.get_layer("dict").records.filter("entity_id = 'wine'").first()["embedding"] == [28.0] and chain.get_layer("none") is None
    m = spark.createDataFrame([(0, "port", 0, 4, [1.0]), (1, "stand", 0, 5, [-1.0])], "text_idx long, text string, start int, end int, vector array<float>")
    cand = chain.get_layer("dict").records.filter("entity_id in ('wine', 'saw')").withColumn("text_idx", F.when(F.col("entity_id") == "wine", 0).otherwise(1).cast("long")).withColumn("mention_idx", F.lit(0)).withColumn("cand_ord", F.lit(1))
    got = L.bi_encoder_links(m, cand, L.labels(cand, "{label} ({description})"), "m", None, threshold=0.5)
    assert [(r["text"], r["label"]) for r in got.collect()] == [("port", "Port Ellory (fortified wine)")]
    assert L.bi_encoder_links(m, cand, L.labels(cand), "other", None).count() == 0
    assert L.bi_encoder_links(m, cand, L.labels(cand), "other", encode, threshold=0.9).count() == 1


def test_vectors_in_label_order(spark):
    rows = spark.createDataFrame([(0, "b", 2, [2.0]), (0, "a", 1, [1.0]), (1, "c", 1, [3.0])], "text_idx long, label_text string, label_ord int, embedding array<float>")
    assert {r["text_idx"]: r["matrix"] for r in L.label_matrix(rows).collect()} == {0: [[1.0], [2.0]], 1: [[3.0]]}
    with pytest.raises(Exception, match="no embedding for b"):
        L.label_matrix(rows.withColumn("embedding", F.when(F.col("label_text") != "b", F.col("embedding")))).collect()
    alike = spark.createDataFrame([("word", "two words"), ("", ""), ("abc", "abc")], "a string, b string").select(S.trigram_similarity(F.col("a"), F.col("b")).alias("s"))
    assert [round(r["s"], 4) for r in alike.collect()] == [0.3636, 0.0, 1.0]
    assert stores.reachable(kb.Layer("x", records=rows)) and not stores.reachable(kb.Layer("y"))


def test_flat_mentions(spark):
    got = lambda *a: [tuple(r) for r in C.flat_mentions(spark, *a).collect()]
    assert got(["a", "b"]) == [(0, 0, "a"), (0, 1, "b")]
    assert got(["a", "b", "c", "d"], [["x"], [], ["x", "x"]]) == [(0, 0, "a"), (2, 0, "b"), (2, 1, "c")]


def test_tokens_are_the_patterns(spark):
    texts = ["", None, "Élan vital—naïve №5 日本 x²", " \n lead", "trail  ", "a", "🙂b🙂", "\x00 z"]
    df = spark.createDataFrame(list(enumerate(texts)), "text_idx long, text string")
    got = sorted((r["text_idx"], r["pos"], r["token"], r["start"]) for r in M.tokens(df).collect())
    assert got == [(i, k + 1, m[0], m.start()) for i, t in enumerate(texts) for k, m in enumerate(regex.finditer(TOKEN, t or ""))]
    want = [(i, m[0], m.start()) for i, t in enumerate(texts) for m in regex.finditer(TOKEN, t or "") if regex.fullmatch(r"\p{L}+", m[0])]
    for pattern in (r"\p{L}+", r"(?!\d)\p{L}+"):  # the second is one by one
        assert sorted((r["text_idx"], r["text"], r["start"]) for r in M.pattern_mentions(df, pattern).collect()) == sorted(want)


def link_rows(spark, rows):
    return spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], LINK)


def test_link_steps(spark):
    x = link_rows(spark, [("tide", "low", 2, 6, 0.25, None), ("tide pool", "rock", 2, 11, 0.75, None), ("tide", "high", 2, 6, 0.375, None), ("pool", "bath", 7, 11, 0.75, None), ("ebb", "low", 20, 23, 0.125, None)])
    assert [(r["label"], r["score"]) for r in L.deduplicate_links(x).orderBy("link_ord").collect()] == [("low", 0.25), ("rock", 0.75), ("bath", 0.75), ("low", 0.125)]
    assert [(r["label"], r["score"]) for r in L.deduplicate_best(x).orderBy("link_ord").collect()] == [("high", 0.375), ("rock", 0.75), ("bath", 0.75), ("low", 0.125)]
    assert [r["label"] for r in L.flat_spans(x).orderBy("link_ord").collect()] == ["rock", "low"]


def test_flat_spans_are_greedy(spark):
    rng = random.Random(8)
    rows = []
    for t in range(30):
        for k in range(rng.randrange(0, 15)):
            a = rng.randrange(0, 40)
            rows.append((t, k, "x", "l", a, a + rng.randrange(1, 8), rng.randrange(0, 5) / 5.0, None))
    want = []
    for t in range(30):
        kept = []
        for r in sorted((r for r in rows if r[0] == t), key=lambda r: (-r[6], r[4], -r[5], r[1])):
            if all(r[5] <= q[4] or r[4] >= q[5] or (r[4], r[5]) == (q[4], q[5]) for q in kept):
                kept.append(r)
        want += [(t, r[1]) for r in kept]
    assert sorted((r["text_idx"], r["link_ord"]) for r in L.flat_spans(spark.createDataFrame(rows, LINK)).collect()) == sorted(want)


def test_streams(spark, tmp_path):
    texts = spark.createDataFrame([(0, "zero again"), (1, "nothing"), (2, "a Trestle and a nought")], "text_idx long, text string")
    texts.repartition(2).write.parquet(f"{tmp_path}/texts")
    records = kb.read_records(spark, RECORDS)
    stream = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/texts")
    link = lambda df: C.exact(C.queries_of(m := M.pattern_mentions(df, r"[\p{L}\p{N}]+")), records).join(m.withColumn("q", F.lower("text")), "q")
    sink = lambda df, n: df.select("text_idx", "entity_id").write.mode("append").parquet(f"{tmp_path}/out")
    ids = linking.exact_stream(stream.select(F.lower("text").alias("q")), kb.label_index(records))
    assert ids.isStreaming and "entity_id" in ids.columns
    linking.link_stream(stream, link, sink, f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(0, "nil"), (2, "nil"), (2, "saw")]


def test_rank(spark):
    """The last candidate of a label counts, an alias where no label is it, half a million at most with this weight."""
    c = spark.createDataFrame([(0, 0, 1, "a", "quay", ["pier"], "", 250000), (0, 1, 1, "b", "quay", ["mole"], "", 500000), (0, 1, 2, "c", "pier", [], "", 3000000), (1, 0, 1, "d", "mole", [], "", 9)], CAND)
    got = L.rank(link_rows(spark, [("q", "quay", 0, 1, 0.25, None), ("m", "mole", 2, 3, 0.0, None), ("p", "pier", 4, 5, 0.5, None), ("x", "none", 6, 7, 1.0, None)]), c, [("gliner_score", 1.0), ("popularity", 3.0)])
    assert [(r["label"], r["score"]) for r in got.orderBy("link_ord").collect()] == [("pier", 0.875), ("quay", 0.4375), ("mole", 0.375), ("none", 0.25)]
    assert L.rank(got, c, []) is got


@pytest.mark.parametrize("links, tolerance, strict, stages", [
    ([("dock", "quay (stone)", 10, 14, 0.625, None)], 0, True, ["l3_linked"]),
    ([("dock", "quay (stone)", 13, 17, 0.625, None)], 3, True, ["l3_linked"]),
    ([("dock", "quay (stone)", 14, 18, 0.625, None)], 3, True, ["l2_found"]),
    ([("dock", "quay (stone)", 9, 13, 0.625, None), ("far", "else", 40, 43, 0.5, None), ("off", "else", 60, 63, 0.25, None)], 1, False, ["l3_linked", "l3_only", "l3_only"]),
])
def test_aggregate(spark, links, tolerance, strict, stages):
    m = spark.createDataFrame([(0, 0, "dock", None, 10, 14, "", "")], MENTION)
    c = spark.createDataFrame([(0, 0, 1, "w", "quay", ["dock"], "stone", 2)], CAND)
    rows = A.aggregate(m, c, link_rows(spark, links), "{label} ({description})", tolerance, strict).orderBy("mention_idx").collect()
    assert [r["stage"] for r in rows] == stages
    assert rows[0]["entity_id"] == ("w" if stages[0] == "l3_linked" else None)
    assert all(r["entity_id"] == "unknown" for r in rows[1:])


def test_stats_of_nothing(spark):
    m = spark.createDataFrame([], MENTION)
    r = A.calculate_stats(A.aggregate(m, spark.createDataFrame([], CAND), spark.createDataFrame([], LINK))).first()
    assert (r["total_mentions"], r["linking_rate"]) == (0, 0.0)
