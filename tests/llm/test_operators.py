"""The operators against brute force, the tokenizers' own results, round trips and held-out rows."""

import gc
import hashlib
import html
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from linkloom.llm import common, embeddings, fingerprints, hmm, html_text, language, packing, piece_encoding, similarity_join, token_counts, toxicity
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# --- 1 and 7: tokenizers ----------------------------------------------------------------------

def test_piece_encoding_is_the_librarys(spark, docs, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        got = piece_encoding.decode(piece_encoding.encode(df, path), path, name="back").collect()
        assert [r["ids"] for r in got] == sp.encode([r["text"] or "" for r in got])
        assert [r["back"] for r in got] == [r["text"] or "" for r in got]
        assert all(r["round_trip"] for r in piece_encoding.report(df, path).collect())
    assert piece_encoding.report(docs.limit(0), path).count() == 0


def test_merges_with_runs_of_spaces():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    cases = ["".join(rng.choice("  ab\n▁ﬁé") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    got = piece_encoding.Encoder(path).encode(cases)
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == sp.encode(cases)


def test_other_models_are_refused():
    field = lambda n, v: bytes([n << 3 & 127 | 2 | (128 if n > 15 else 0), *([n >> 4] if n > 15 else []), len(v)]) + v
    number = lambda n, v: bytes([n << 3 & 127 | (128 if n > 15 else 0), *([n >> 4] if n > 15 else []), v])
    plain = number(3, 1) + number(4, 0)
    piece_encoding.check_model(field(2, number(3, 2) + number(35, 1)) + field(3, plain))
    for trainer, normal in ((number(3, 1) + number(35, 1), plain), (number(3, 2), plain), (number(3, 2) + number(35, 1), number(3, 1)), (number(3, 2) + number(35, 1), plain + field(2, b"x"))):
        with pytest.raises(ValueError):
            piece_encoding.check_model(field(2, trainer) + field(3, normal))


def test_compatible_pairs_are_those_that_merges_leave():
    p = piece_encoding.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    def merged(symbols):
        """All merges, best first, leftmost among equals."""
        while True:
            options = [(-p.score[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in p.score]
            if not options:
                return symbols
            i = min(options)[1]
            symbols = symbols[:i] + [symbols[i] + symbols[i + 1]] + symbols[i + 2:]

    rng = np.random.default_rng(20)
    texts = p.patterns.texts
    for a, b in rng.integers(0, len(texts), (3000, 2)).tolist():
        assert p.compatible(a << 32 | b) == (merged(list(texts[a] + texts[b])) == [texts[a], texts[b]]), (texts[a], texts[b])


def test_token_counts(spark, docs, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for df in (docs, odd):
        got = token_counts.token_counts(df, path, sample_docs=20, cache_entries=50).collect()
        assert [r["n_tokens"] for r in got] == [len(e.ids) for e in tok.encode_batch([r["text"] or "" for r in got], add_special_tokens=False)]
    assert token_counts.token_counts(none, path).count() == 0


def test_pre_tokens_with_odd_white_space():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(2)
    cases = ["".join(rng.choice("  \xa0 \n\x1c!a1's<|endoftext|>") for _ in range(40)) for _ in range(300)] + ["a<|endoftext|> <|endoftext|>b"]
    import io

    import pyarrow as pa

    out, t = io.BytesIO(), pa.table({"w": pa.array([], pa.string()), "n": pa.array([], pa.uint16())})
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    assert token_counts.Lengths(path, out.getvalue(), 100).counts(cases) == [len(tok.encode(c, add_special_tokens=False).ids) for c in cases]


# --- 2: language model ------------------------------------------------------------------------

def test_forward_and_counts_are_sums_over_all_paths():
    rng = np.random.default_rng(0)
    k, c = 3, 5
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T
    seqs = [rng.integers(0, c, n) for n in (1, 4, 2, 6)]
    offs = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    total, starts, moves, emissions = [], np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
    for s in seqs:
        paths = list(itertools.product(range(k), repeat=len(s)))
        p = np.array([start[q[0]] * np.prod([move[a, b] for a, b in zip(q, q[1:])]) * np.prod([emit[x, a] for x, a in zip(s, q)]) for q in paths])
        total.append(np.log(p.sum()))
        for q, w in zip(paths, p / p.sum()):
            starts[q[0]] += w
            for a, b in zip(q, q[1:]):
                moves[a, b] += w
            for x, a in zip(s, q):
                emissions[x, a] += w
    tokens = np.concatenate(seqs)
    assert np.allclose(hmm.forward(tokens, offs, start, move, emit), total)
    got = hmm.expected_counts(tokens, offs, start, move, emit)
    for x, y in zip(got, (starts, moves, emissions, sum(total))):
        assert np.allclose(x, y, atol=1e-4)


def test_frequent_words_are_all_words_above_a_count(spark, monkeypatch):
    rows = [(f"w{i}".encode(), c) for i, c in enumerate([9, 9, 7, 5, 5, 5, 1, 1, 1, 1])]
    counts = spark.createDataFrame([(bytearray(w), c) for w, c in rows], "word binary, c long")
    for room, want, least in ((100, 10, 1), (9, 6, 5), (5, 3, 7), (1, 0, 1 << 62)):
        monkeypatch.setattr(hmm, "TABLE", room)
        top, n, v, low = hmm._frequent(counts)
        assert (len(top), n, v, low) == (want, 44, 10, least) and top == sorted(top, key=lambda x: (-x[1], x[0]))


def test_language_model(spark, docs, odd, none):
    rows = docs.select("doc_id", "text", (common.crc_mod("doc_id", 7) != 2).alias("train"))
    got = {r["doc_id"]: r for r in hmm.score(rows, rounds=2).collect()}
    words = {d: t.encode().lower().split() + [b"\n"] for d, t in texts_of(docs)}
    seen = defaultdict(int)
    for d, ws in words.items():
        if got[d]["train"]:
            for w in ws:
                seen[w] += 1
    n, v = sum(seen.values()), len(seen)
    for d, ws in words.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in seen for w in ws), n)
        assert abs(r["base_score"] - sum(np.log10((seen.get(w, 0) + 1) / (n + v + 1)) for w in ws)) < 1e-6 * max(1, len(ws))
    held = [r for r in got.values() if not r["train"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert hmm.score(odd.select("doc_id", "text", F.lit(True).alias("train")), rounds=1).filter("n_tokens >= 1 and score <= 0").count() == 11
    assert hmm.score(none.select("doc_id", "text", F.lit(True).alias("train")), rounds=1).count() == 0


# --- 3: language ID ---------------------------------------------------------------------------

def test_language(spark, docs, odd, none):
    held = docs.withColumn("held", common.crc_mod("doc_id", 5) == 0)
    model = language.train(held.filter("not held"))
    got = language.identify(held, model).filter("held").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.9 and all(0 <= r["lang_score"] <= 1 for r in got)
    rows = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, model).collect()}
    assert [rows[i] for i in (1, 2, 3)] == ["und"] * 3 and rows[5] != "und"
    mixed = " ".join(r["text"] for l in ("en", "de") for r in docs.filter(F.col("lang") == l).limit(3).collect())
    assert language.identify(spark.createDataFrame([(mixed,)], "text string"), model).first()["n_langs"] >= 2
    assert language.identify(odd, language.train(none)).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(none, model).count() == 0


def test_mixture_is_the_likeliest():
    """EM's proportions against a grid, and the choice of the language set against all sets."""
    rng = np.random.default_rng(12)
    for case in range(20):
        n, k = int(rng.integers(2, 30)), 3
        true = rng.dirichlet(np.ones(k) * 0.4)
        ll = rng.normal(-40, 3, (n, k))
        ll[np.arange(n), rng.choice(k, n, p=true)] += rng.uniform(2, 12)
        at = np.array([0, n])
        grid = np.array([(a, b, 1 - a - b) for a in np.linspace(0, 1, 41) for b in np.linspace(0, 1, 41) if a + b <= 1 + 1e-9]).clip(0)
        value = lambda w: np.log(np.exp(ll - ll.max()) @ w + 1e-300).sum() + n * ll.max()  # noqa: B023, E731
        theta, got = language.proportions(ll, at, np.ones((1, k)), steps=300)
        assert got[0] >= max(value(w) for w in grid) - 1e-6 and np.isclose(theta.sum(), 1)
        main, score, chosen = language.infer(ll, at)
        sets = [s for r in range(1, k + 1) for s in itertools.combinations(range(k), r)]
        fits = {}
        for s in sets:
            allowed = np.zeros((1, k))
            allowed[0, list(s)] = 1
            fits[s] = language.proportions(ll, at, allowed, steps=8)[1][0] - language.PENALTY * (len(s) - 1)
        mine = tuple(np.flatnonzero(chosen[0]).tolist())
        # Languages are added one by one, so the set is at least as good as the best single one, and nothing can be added.
        assert fits[mine] >= max(fits[s] for s in sets if len(s) == 1) - 1e-6
        assert all(fits[s] <= fits[mine] + 1e-6 for s in sets if len(s) == len(mine) + 1 and set(mine) < set(s))
        assert main[0] == chosen[0].argmax() and 0 <= score[0] <= 1


# --- 4: fingerprints --------------------------------------------------------------------------

def bottom(text, k=256, words=5):
    """The k smallest 48-bit shingle hashes of a text, all at once."""
    got = next(common.shingle_sets(pa.array([text]), words)) >> np.uint64(16)
    return np.unique(got)[:k]


def likeness(a, b, k=256):
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:k]
    return len(np.intersect1d(np.intersect1d(a, b), both)) / len(both)


def test_fingerprints(spark, docs, odd, none):
    big = spark.createDataFrame([((1 << 60) + i, t) for i, t in enumerate(["a b c d e f g", "same text here", "same text here", ""])] + [(None, "no id")], "doc_id long, text string")
    for df in (docs, odd.select("doc_id", "text").distinct(), big, big.filter("doc_id is not null")):
        rows = sorted(((d, t) for d, t in texts_of(df)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        got = {}
        for r in fingerprints.edit_report(df).collect():
            got.setdefault(r["doc_id"], []).append(r)
        assert sum(map(len, got.values())) == len(rows)
        for i, (d, t) in enumerate(rows):
            r = next(x for x in got[d] if x["n_chars"] == len(t))
            after = rows[(i + 1) % len(rows)][1]
            edited = fingerprints.edited_text(t, after)
            s, e, n = bottom(t), bottom(edited), bottom(after)
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.to_text(s), fingerprints.to_text(e))
            assert np.isclose(r["near_edited"], likeness(s, e)) and np.isclose(r["near_next"], likeness(s, n))
    assert fingerprints.edit_report(none).count() == 0


def test_sketches():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 48, 5000).astype(np.uint64))
    b = np.unique(np.concatenate([a[::2], rng.integers(0, 1 << 48, 2500).astype(np.uint64)]))
    k = 512
    sa, sb = a[:k], b[:k]
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(fingerprints.resemblance(sa, sb, k) - true) < 0.08 and abs(fingerprints.containment(sa, sb, k) - 0.5) < 0.12
    assert abs(fingerprints.distinct_count(sa, k) / len(a) - 1) < 0.15
    assert (fingerprints.merge(sa, sb, k) == np.union1d(a, b)[:k]).all()
    assert (fingerprints.from_text(fingerprints.to_text(sa)) == sa).all()


# --- 5: toxicity ------------------------------------------------------------------------------

def test_toxicity(spark, odd, none):
    rng = random.Random(3)
    say = lambda bad: " ".join([rng.choice(["house", "tree", "river", "stone", "cloud", "garden"]) for _ in range(40)] + ([rng.choice(["idiot", "worthless", "moron"])] if bad else []))
    y = np.array([i % 3 == 0 for i in range(300)], int)
    model = toxicity.train([say(v).encode() for v in y], y, epochs=40)
    z = toxicity.margins([b"house tree river worthles stone cloud", b"house tree river stone cloud", b""], model, {})
    assert z[0] > 0 > z[1]
    assert toxicity.score(odd, model).filter("score between 0 and 1 and predicted in (0, 1)").count() == 11
    assert toxicity.score(none, model).count() == 0
    labels = spark.createDataFrame([(5, 1, 1), (5, 1, None), (6, 0, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == 11
    assert toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).filter("predicted = 1").count() == 0


def test_toxicity_of_held_out_documents(spark):
    """Real labels (some of them wrong on purpose): documents that taught nothing are told apart."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", (common.crc_mod("doc_id", 3) == 1).alias("held"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(common.crc_mod("doc_id", 3) != 1))
    got = toxicity.score(docs, model).filter("held").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    of = lambda k, v: np.array([r[k] for r in got if r["toxic"] == v])
    assert of("predicted", 1).mean() > 0.3 and of("predicted", 0).mean() < 0.03
    assert (of("score", 1)[:, None] > of("score", 0)[None]).mean() > 0.8
    # The sum over words is the whole network's answer.
    text = b"some words, of a TEXT some"
    key, weight = toxicity._bag(text)
    z = float((model["vectors"][key] * weight).sum() + model["bias"])
    assert np.isclose(toxicity.margins([text], model, {})[0], z, atol=1e-5)


def test_two_models_in_one_worker(spark, docs):
    """What a worker keeps for one model never serves another."""
    one = spark.sparkContext.parallelize([0], 1).map(lambda x: ("house tree river",)).toDF("text string")
    rows = []
    for i in range(6):
        model = {"vectors": np.full(toxicity.TABLE, float(i - 3), np.float32), "bias": 0.0}
        rows.append(toxicity.score(one.coalesce(1), model).first()["score"])
        gc.collect()
    assert rows == sorted(rows) and len(set(rows)) == 6


# --- 6: pages ---------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><script>if (a < b) "</p>"</script></head><body><header>Site</header><nav><ul><li>Menu</li></ul></nav><div class="ad">Buy</div>
<article><h1>Head&amp;line</h1><p>One <b>two</b>&nbsp; three<br>four<p class="x">five &lt;six&gt;<div class=comments><p>Great!</div></article><aside>Side</aside><footer>&copy; me</footer>"""


def test_page():
    assert " ".join(t for t, m in html_text.page_blocks(PAGE) if m) == "Head&line One two three four five <six>"
    assert html_text.page_blocks("") == [] and html_text.page_blocks("<div>a</div>b") == [("a", False), ("b", False)]


def test_hosts(spark):
    rng = random.Random(4)
    bar = "subscribe to our weekly letter and never miss a story again"
    body = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(9)]
    rows = [(i, "http://h.example/x", f"<div>{bar}</div><p>{b}</p><div>{bar}</div>") for i, b in enumerate(body)] + [(50, None, None), (51, "http://lone.example/", "<p>only one page</p>"), (52, "", ""), (52, "", "")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == dict(enumerate(body)) | {50: "", 51: "only one page", 52: ""} and len(got) == 13
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_tokens_are_those_of_brute_force():
    rng = random.Random(14)
    for _ in range(60):
        pages = [[rng.choice("abcd") for _ in range(rng.randrange(0, 25))] for _ in range(rng.randrange(1, 9))]
        run, least = rng.randrange(2, 6), rng.randrange(2, 4)
        has = defaultdict(set)
        for i, p in enumerate(pages):
            for j in range(len(p) - run + 1):
                has[tuple(p[j: j + run])].add(i)
        want = [[any(len(has[tuple(p[j: j + run])]) >= least for j in range(max(0, k - run + 1), min(k, len(p) - run) + 1)) for k in range(len(p))] for p in pages]
        assert [x.tolist() for x in html_text.repeated_tokens(pages, run, least)] == want


def test_given_pages(spark):
    """Pages of the given table against the article element taken out by a parser of its own, with clashing columns."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(pages.withColumn("text", F.lit("x")).withColumn("host", F.lit(1)).withColumn("n_chars", F.lit(2))).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        part = re.search(r"<(article|main)\b[^>]*>(.*)</\1>", r["html"], re.S)
        body = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", " ", part[2], flags=re.S)
        words = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        mine = got[r["page_id"]]["text"].split()
        # Only words that stand in the article, in its order, and all but what is marked as not part of it.
        at = iter(words)
        assert all(w in at for w in mine) and (len(mine) >= 0.9 * len(words) or re.search(r"class=|<aside|<form|<nav", body))


def test_a_very_long_page(spark):
    body = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, "http://h.example/", f"<article><p>{body}</p></article>"), (2, "http://h.example/", "<div>" * 20_000 + body + "</div>" * 20_000)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: body, 2: body}


# --- 8: packing -------------------------------------------------------------------------------

def check_packing(rows, size):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= size
    return len(seqs)


def test_packing(spark, docs, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for df in (docs, odd):
        rows = packing.best_fit_pack(df, path, 128, 0, group=50).collect()
        want = []
        for d, t in texts_of(df):
            ids = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4")
            want += [(d, k, s, len(ids[s: s + 128]), zlib.crc32(ids[s: s + 128].tobytes())) for k, s in enumerate(range(0, len(ids), 128))]
        key = lambda x: tuple(-1 if v is None else v for v in x)
        assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
        n = check_packing(rows, 128)
        bound = packing.bin_bound(np.array([r["length"] for r in rows if r["length"] < 128], np.int64), 128) + sum(r["length"] == 128 for r in rows)
        assert {r["over_bound"] for r in rows} == {n - bound} and n - bound <= 1 + n // 50
    assert packing.best_fit_pack(none, path, 128).count() == 0


def test_bounds():
    rng = np.random.default_rng(5)
    for _ in range(20):
        w = rng.integers(1, 100, 300)
        bins, offs = packing.best_fit_decreasing(w, 100)
        assert packing.bin_bound(w, 100) <= bins.max() + 1
        assert (np.bincount(bins, weights=w) <= 100).all()
    assert packing.bin_bound(np.array([51] * 10), 100) == 10
    assert packing.bin_bound(np.array([34] * 9), 100) == 5


# --- 9: similarity join -----------------------------------------------------------------------

def brute(rows, words, percent):
    sets, parent = {}, {}
    for d, t in rows:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i: i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("words, percent, rows_at_once", [(3, 90, 512), (3, 90, 4), (5, 80, 4)])
def test_similarity(spark, words, percent, rows_at_once, monkeypatch):
    rng = random.Random(6)
    rows = []
    for g in range(25):
        base = [f"t{rng.randrange(300)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 9)):
            text = [w if rng.random() > rng.choice([0, 0.01, 0.03]) else f"z{rng.randrange(50)}" for w in base]
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(similarity_join, "BLOCK_ROWS", rows_at_once)  # few split the blocks
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similarity_join.similarity_components(df, words, percent).collect()}
    assert got == brute(rows, words, percent)


@pytest.mark.parametrize("rows_at_once", [512, 8])
def test_large_blocks_of_near_copies(spark, monkeypatch, rows_at_once):
    """Groups whose members are alike along chains, all in the same blocks: links that no centre has."""
    rng = random.Random(16)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(100)]
        for _ in range(60):
            text, at = list(base), rng.randrange(0, 100)
            for k in range(rng.randrange(0, 14)):
                text[(at + k) % 100] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1000, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(similarity_join, "BLOCK_ROWS", rows_at_once)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similarity_join.similarity_components(df, 3, 90).collect()}
    assert got == brute(rows, 3, 90) and len({c for _, c in got.values()}) > 10


def test_an_id_of_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    df = spark.createDataFrame([(5, a), (5, b), (3, a), (7, b), (5, a), (9, "c")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in similarity_join.similarity_components(df, 3, 90).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (5, 5), (7, 5), (9, 9)]


def test_spanning_links_join_what_all_links_join():
    rng = np.random.default_rng(17)
    base = np.unique(rng.integers(0, 1 << 60, 50).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > 0.08], rng.integers(0, 1 << 60, 3).astype(np.uint64)])) for _ in range(60)]
    links = similarity_join.spanning_links(sets, np.arange(60), 80)
    like = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    of = lambda pairs: similarity_join.connected(60, *np.array(pairs, np.int64).reshape(-1, 2).T).tolist()
    assert len(links) < 60 < len(like) and of(links) == of(like)


def test_similarity_of_odd_rows(spark, odd, none):
    got = similarity_join.similarity_components(odd, 3, 90).collect()
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == 11 and comp == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, None: None}
    assert similarity_join.similarity_components(none, 3, 90).count() == 0


def test_tree_loses_nothing():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[rng.random(len(s)) > 0.03], rng.integers(0, 1 << 60, 2).astype(np.uint64)])) for s in sets for _ in range(2)]
    n, ids = np.array([len(s) for s in sets]), np.arange(len(sets))
    a, b = similarity_join.tree_pairs(n, np.stack([similarity_join.signature(s) for s in sets]), ids, 80)
    got = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
    for i in ids:
        for j in ids[i + 1:]:
            k = len(np.intersect1d(sets[i], sets[j]))
            assert (int(i), int(j)) in got or 100 * k < 80 * (n[i] + n[j] - k)


def test_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(500, 500)]
    parent = {}
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["id"]: r["component_id"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


# --- 10: embeddings ---------------------------------------------------------------------------

def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 64))
    for i in range(0, 120, 3):
        x[i + 1] = x[i] * 3 + rng.normal(size=64) * 0.3
        x[i + 2] = x[i]
    x[200:260] = x[200] + rng.normal(size=(60, 64)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [float("nan")] * 64), (1004, [None] + [1.0] * 63), (1005, [1.0, 2.0])]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.95) & ~np.eye(400, dtype=bool)
    for chunk in (512, 16):
        monkeypatch.setattr(embeddings, "CHUNK", chunk)
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        assert sum(got[i]["n_links"] for i in range(400)) >= 0.98 * link.sum()
        assert all(got[i]["n_links"] <= link[i].sum() for i in range(400))
        assert all(got[i]["component_id"] == 200 for i in range(200, 260)) and all(got[i]["kept"] and not got[i]["n_links"] for i in range(1000, 1006))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_at_the_threshold(spark):
    """Pairs from 0.93 to 0.97, ids that repeat or lack, columns of other names: against all pairs."""
    rng = np.random.default_rng(19)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.normal(size=x.shape)
    r -= (r * x).sum(1, keepdims=True) * x
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    c = rng.uniform(0.93, 0.97, (300, 1))
    both = np.concatenate([x, c * x + np.sqrt(1 - c * c) * r])
    ids = list(range(600))
    rows = [(i, (v * 7).tolist(), 1, "k", 2) for i, v in zip(ids, both)] + [(5, (both[9] * 2).tolist(), 1, "k", 2), (5, both[5].tolist(), 1, "k", 2), (None, both[7].tolist(), 1, "k", 2)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, key string, m long")).collect()
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.95) & ~np.eye(600, dtype=bool)
    mine = {r["vec_id"]: r for r in got if r["vec_id"] not in (5, 9, None)}
    want = {i: int(link[i].sum()) + int(link[i, 5]) + int(link[i, 9]) for i in mine}  # two vectors are there twice
    assert sum(r["n_links"] for r in mine.values()) >= 0.995 * sum(want.values()) > 100 and all(r["n_links"] <= want[i] for i, r in mine.items())
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, None)] and len(got) == 603
    assert sum(r["vec_id"] == 5 for r in got) == 3 and {r["component_id"] for r in got if r["vec_id"] == 9} == {5}


def test_tables_grow_with_the_vectors():
    few, many = embeddings.settings(10_000, 64, 0.95), embeddings.settings(10**9, 64, 0.95)
    assert few[0] < many[0] <= 6 and few[1] < many[1] <= 120 and (128 ** many[0]) >= 10**9


# --- pipeline ---------------------------------------------------------------------------------

def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    at, columns = docs, docs.columns
    for name, stage in P.STAGES[:-1]:
        before = {r["doc_id"] for r in at.collect()}
        at = common.write_table(stage(spark, at, SMALL), name)
        ids = [r["doc_id"] for r in at.collect()]
        assert at.columns == columns and len(ids) == len(set(ids)) and set(ids) <= before
    rows = P.STAGES[-1][1](spark, at, SMALL).collect()
    assert {r["doc_id"] for r in rows} == set(ids)
    check_packing(rows, 2048)
