"""Operator 13 against all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from linkloom.llm import spelling as S


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(a[:i] + a[i + (len(a) == len(b)):] == b[:i] + b[i + 1:] for i in range(len(b)))


def brute_words(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            total[w[: h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    return {w: n for w, n in total.items() if n >= 3 and len(w) >= 5}


def brute(words):
    nears = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(nears[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(nears[w]), words.get(form[w], 0)) for w, n in words.items())


def rows_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def made_words(n=700, seed=2):
    rng = np.random.default_rng(seed)
    alphabet = list("abcdé") + ["ÿ", "×"]
    stems = ["".join(rng.choice(alphabet, int(rng.integers(5, 9)))) for _ in range(60)]
    out = {"aaaaa": 5, "aaaaaa": 11, "aaaaaaa": 30, "abababab": 4, "babababa": 4, "ababababa": 9, "x" * 90: 4, "x" * 91: 9, "x" * 89 + "y": 3, "é" * 70 + "ab": 3, "é" * 70 + "ba": 8}
    while len(out) < n:
        w = list(stems[int(rng.integers(len(stems)))])
        for _ in range(int(rng.integers(0, 4))):
            i = int(rng.integers(len(w)))
            w[i: i + int(rng.integers(0, 2))] = list(rng.choice(alphabet, int(rng.integers(0, 3))))
        if len(w) >= 5:
            out["".join(w)] = int(rng.integers(3, 200))
    return out


@pytest.mark.parametrize("level, most", [(3, 512), (1, 8), (3, 2)])
def test_all_near_pairs_once(spark, level, most):
    words = {w: n for w, n in made_words().items() if most > 100 or len(w) < 20}  # long words need many rounds of one more token
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = [tuple(sorted((r["a"], r["b"]))) for r in S.near_pairs(df, level, most).collect()]
    want = {tuple(sorted((a, b))) for a in words for b in words if a < b and near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want
    assert rows_of(S.variant_forms(df, S.near_pairs(df, level, most))) == brute(words)


def test_one_edit():
    for a, b, want in ((b"abc", b"abd", True), (b"abc", b"abc", False), (b"abc", b"abcd", True), (b"abc", b"xabc", True), (b"abc", b"axbc", True), (b"abc", b"acb", False), (b"abc", b"abcde", False), (b"aa", b"aaa", True)):
        assert S.one_edit(a, b) is want


def test_words_of_texts(spark, odd, none, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 64)
    monkeypatch.setattr(S, "FLUSH", 10)
    rows = [(i, "Straße ÄRGER naïve × ÷ tester testes testers O'Neill " * (i % 7) + "abcdefgh" * (i % 40)) for i in range(300)] + [(None, "tester " * 400), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["word"]: r["n"] for r in S.word_counts(df).collect()}
    assert got == brute_words(rows)
    assert rows_of(S.spelling_variants(df)) == brute(brute_words(rows))
    odd_rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert {r["word"]: r["n"] for r in S.word_counts(odd).collect()} == brute_words(odd_rows)
    assert S.spelling_variants(none).count() == 0
