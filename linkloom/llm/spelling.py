"""Spelling variants: the words of a corpus, which of them are one edit apart, and the form that each leads to.

Words come from maximal runs of letters; near words from a positional q-gram inverted index with a count filter; forms
and roots from the near words' counts.

Index. A word's tokens are its padded bigrams, numbered where they repeat, in an order that has rare bigrams first. A
word of L letters has L + 1 tokens, and one edit takes away two at most, so two near words share at least
max(L) - 1 of them and, of those, the first `LEVEL` are among the first LEVEL + 2 tokens of each (prefix lemma). So
each word is posted under every choice of LEVEL of its first LEVEL + 2 tokens and the length limit, and postings of a
key meet by one shuffle. There pairs under the length limit are counted by place: a bigram counts if the other word
has it at the same place, or one later in the longer word. Pairs below the bound go; the others are compared letter by
letter. A pair is taken under the key of its first shared tokens only.

A key with more than `MOST` postings is not paired: its words are posted again under one token more, until the
shared tokens are as many as near words must share, which few words can have. So no task pairs a large group, and no
pair is lost."""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain, combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, partition_count, small_batches, write_table

RUNS = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
NO_RUN = re.compile(rb"[^a-z\xc3\x80-\xbf]")
PIECE = 1 << 20  # bytes of a text whose runs are listed at once
FLUSH = 1 << 18  # words counted in a task before they go out
LEVEL = 3
MOST = 512
PAIRS = 1 << 18  # pairs compared at once
LONG = 64  # letters beyond which words are compared one by one
LETTERS = 91  # a-z, U+00C0 to U+00FF and the padding
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[192:256] = np.arange(27, 91)


# --- words -----------------------------------------------------------------------------------

def _pieces(text: bytes):
    """A text in pieces that cut no run."""
    at = 0
    while len(text) - at > PIECE:
        end = NO_RUN.search(text, at + PIECE)
        if end is None:
            break
        yield text[at: end.end()]
        at = end.end()
    yield text[at:]


def word_counts(docs: DataFrame, one_in: int = 97, letters: int = 5, least: int = 3) -> DataFrame:
    """(word, n): how often each word occurs in all texts. Runs `[A-Za-z\\u00C0-\\u00FF]+` of whole texts, with A-Z in
    lower case; a run whose h = crc32 of `<doc_id>:<run>` is a multiple of `one_in` loses code point h % length. Words of
    fewer code points than `letters` or fewer occurrences than `least` go. Null texts have no runs; a null id counts
    as the empty text; repeated rows count each."""
    small_batches(docs.sparkSession, 500)

    def count(batches):
        total: Counter = Counter()

        def out():
            words = [w for w, n in total.items() if n and len(w) - w.count(0xC3) >= letters]
            got = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])
            total.clear()
            return got

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                start = crc32(f"{i}:".encode()) if i is not None else crc32(b":")
                for piece in _pieces((text or b"").lower()):
                    runs = RUNS.findall(piece)
                    total.update(runs)
                    hit = {w for w in set(runs) if crc32(w, start) % one_in == 0}
                    if hit:
                        for w in filter(hit.__contains__, runs):
                            s, h = w.decode(), crc32(w, start)
                            total[w] -= 1
                            total[(s[: h % len(s)] + s[h % len(s) + 1:]).encode()] += 1
                    if len(total) > FLUSH:
                        yield out()
        yield out()

    got = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n long")
    return got.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# --- index -----------------------------------------------------------------------------------

def _grams(words: list[bytes]) -> np.ndarray:
    """The bigrams of words of one length: a row each of length + 1 numbers below 91 * 91."""
    n, length = len(words), len(words[0])
    c = np.zeros((n, length + 2), np.int64)
    c[:, 1:-1] = _CODE[np.frombuffer(b"".join(words), np.uint8).reshape(n, length)]
    return c[:, :-1] * LETTERS + c[:, 1:]


def _tokens(grams: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The tokens of each row in their order: a bigram's place in the order, and how often it came before."""
    r = np.sort(order[grams], axis=1)
    seen = np.zeros_like(r)
    for j in range(1, r.shape[1]):
        seen[:, j] = np.where(r[:, j] == r[:, j - 1], seen[:, j - 1] + 1, 0)
    return (r << 32) | seen


def _key(tokens: np.ndarray, shorter: np.ndarray | int) -> np.ndarray:
    """The key of each row of chosen tokens, for pairs whose shorter word has so many letters, which (63 at
    most) are its last six bits."""
    k = np.broadcast_to(np.asarray(shorter, np.uint64), tokens.shape[:1]).copy()
    m = np.minimum(k, np.uint64(63))
    for j in range(tokens.shape[1]):
        k = mix(k * np.uint64(0x9E3779B97F4A7C15) + tokens[:, j].astype(np.uint64))
    return ((k << np.uint64(6)) | m).view(np.int64)


def _by_length(words: list[bytes]):
    """Places of the words of each length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths).tolist():
        yield n, np.flatnonzero(lengths == n)


def _order(words: DataFrame) -> np.ndarray:
    """The place of each bigram, rare ones first: 91 * 91 numbers, whatever the corpus."""
    def count(batches):
        got = np.zeros(LETTERS * LETTERS, np.int64)
        for b in batches:
            flat = [w.encode("latin-1") for w in b.column(0).to_pylist()]
            for _, at in _by_length(flat):
                got += np.bincount(_grams([flat[i] for i in at]).ravel(), minlength=len(got))
        g = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(got[g])], names=["gram", "n"])

    t = words.select("word").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(LETTERS * LETTERS, np.int64)
    n[t["gram"].to_numpy()] = t["n"].to_numpy()
    out = np.zeros(len(n), np.int64)
    out[np.lexsort((np.arange(len(n)), n))] = np.arange(len(n))
    return out


def _post(words: DataFrame, order: np.ndarray, level: int, inside: bool) -> DataFrame:
    """(key, word, n): each word under its keys of `level` tokens; `inside`: under those that go on from the key that
    is given with it, of one token less."""
    def post(batches):
        for b in batches:
            flat = [w.encode("latin-1") for w in b.column("word").to_pylist()]
            old = b.column("key").to_numpy() if inside else None
            keys, rows = [], []
            for length, at in _by_length(flat):
                if length <= level and not inside:
                    raise ValueError(f"words need more than {level} letters")
                tokens = _tokens(_grams([flat[i] for i in at]), order)
                for shorter in (length - 1, length):
                    for c in combinations(range(min(level + 2, length + 1)), level):
                        ok = np.arange(len(at))
                        if inside:
                            ok = np.flatnonzero(_key(tokens[:, c[:-1]], shorter) == old[at])
                        keys.append(_key(tokens[np.ix_(ok, c)], shorter))
                        rows.append(at[ok])
            at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column("word").take(pa.array(at)), b.column("n").take(pa.array(at))], names=["key", "word", "n"])

    return words.select(*(["key"] if inside else []), "word", "n").mapInArrow(post, "key long, word string, n long")


def _pairs(sizes: np.ndarray):
    """All pairs within runs of these sizes, `PAIRS` or so at once: the places of both."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    after = np.repeat(first[1:], sizes) - np.arange(first[-1]) - 1  # pairs that each place begins
    total = np.concatenate([[0], np.cumsum(after)])
    i = 0
    while i < len(after):
        j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")) - 1)
        a = np.repeat(np.arange(i, j), after[i:j])
        yield a, a + 1 + np.arange(len(a)) - np.repeat(total[i:j] - total[i], after[i:j])
        i = j


def one_edit(a: bytes, b: bytes) -> bool:
    """Do two words, a not longer than b, differ by exactly one letter put in, taken away or replaced?"""
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def _near(keys: np.ndarray, words: list[bytes], order: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The near pairs (places, the shorter word first) of postings that are sorted by key, each under the key of the
    first tokens that it shares."""
    lengths = np.array([len(w) for w in words], np.int64)
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([begin, [len(keys)]]))
    wide = int(min(lengths.max(), LONG))
    letters = np.zeros((len(words), wide + 1), np.uint8)
    grams = np.full((len(words), wide + 2), -1, np.int16)
    tokens = np.full((len(words), level + 2), -1, np.int64)
    marks = np.zeros(len(words), np.uint64)
    for length, at in _by_length(words):
        own = [words[i] for i in at]
        g = _grams(own)
        t = _tokens(g, order)[:, : level + 2]
        tokens[at, : t.shape[1]] = t
        if length <= LONG:
            letters[at, :length] = np.frombuffer(b"".join(own), np.uint8).reshape(len(at), length)
            grams[at, : length + 1] = g
            for j in range(length + 1):
                marks[at] |= np.uint64(1) << (mix(g[:, j]) >> np.uint64(58))
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _pairs(sizes):
        swap = lengths[a] > lengths[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        # Length limit, and a first bound: an edit takes two bigrams away and brings two, so four marks differ at most.
        fits = (lengths[b] - lengths[a] <= 1) & ((np.bitwise_count(marks[a] ^ marks[b]) <= 4) | (lengths[b] > LONG))
        a, b = a[fits], b[fits]
        small = lengths[b] <= LONG
        at = np.flatnonzero(small)
        i, j = a[at], b[at]
        longer = lengths[j] > lengths[i]
        x, y = grams[i], grams[j]
        counted = (x == y) & (x >= 0)
        counted[:, :-1] |= (x[:, :-1] == y[:, 1:]) & (x[:, :-1] >= 0) & longer[:, None]
        over = counted.sum(axis=1) >= lengths[j] - 1
        at, i, j, longer = at[over], i[over], j[over], longer[over]
        x, y = letters[i], letters[j]
        differ = x != y
        front = np.where(differ.any(axis=1), np.argmax(differ, axis=1), wide + 1)
        moved = (x[:, :-1] == y[:, 1:]) | (np.arange(wide) < front[:, None])
        keep = np.zeros(len(a), bool)
        keep[at] = np.where(longer, moved.all(axis=1), differ.sum(axis=1) == 1)
        for k in np.flatnonzero(~small).tolist():
            keep[k] = one_edit(words[a[k]], words[b[k]])
        a, b = a[keep], b[keep]
        # Both words have the pair's first shared tokens among their first ones; only under their key it is taken.
        p, q = tokens[a], tokens[b]
        shared = ((p[:, :, None] == q[:, None, :]) & (p >= 0)[:, :, None]).any(axis=2)
        which = np.argsort(~shared, axis=1, kind="stable")[:, :level]
        here = _key(np.take_along_axis(p, which, axis=1), lengths[a]) == keys[a]
        out_a.append(a[here])
        out_b.append(b[here])
    return np.concatenate(out_a), np.concatenate(out_b)


FOUND = "key long, a string, a_n long, b string, b_n long"


def near_pairs(words: DataFrame, level: int = LEVEL, most: int = MOST) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words (word, n) that are one edit apart, once. Words are distinct and have more
    letters than `level`."""
    spark = words.sparkSession
    small_batches(spark, 20_000)
    order, given, out = _order(words), words, None
    first = level
    while True:
        def merge(batches, level=level):
            passed = None  # the key over the limit that may go on

            def rows(key, a, a_n, b, b_n):
                return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), a, a_n, b, b_n], names=["key", "a", "a_n", "b", "b_n"])

            def settle(t):
                """Pairs under small keys; postings under large ones, but for those that share what near words must."""
                keys, word, n = t["key"].to_numpy(), t["word"].combine_chunks(), t["n"].combine_chunks()
                begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                sizes = np.diff(np.concatenate([begin, [len(keys)]]))
                size = np.repeat(sizes, sizes)
                large = ((size > most) | (keys == passed)) & ((keys & 63) > level + 1)
                at = pa.array(np.flatnonzero(large))
                if len(at):
                    yield rows(keys[large], word.take(at), n.take(at), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.int64()))
                small = np.flatnonzero((size > 1) & ~large)
                if len(small):
                    word, n = word.take(pa.array(small)), n.take(pa.array(small))
                    a, b = map(pa.array, _near(keys[small], [w.encode("latin-1") for w in word.to_pylist()], order, level))
                    yield rows(np.zeros(len(a)), word.take(a), n.take(a), word.take(b), n.take(b))

            held = []
            for b in chain((b for b in batches if b.num_rows), [None]):
                if b is not None:
                    held.append(b)
                t = pa.Table.from_batches(held) if held else None
                if t is None:
                    return
                keys = t["key"].to_numpy()
                cut = len(keys) if b is None else int(np.argmax(keys == keys[-1]))
                if cut:
                    yield from settle(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                if len(keys) - cut > most and (keys[-1] & 63) > level + 1:
                    passed = keys[-1]
                    yield from settle(t.slice(cut))
                    held = []

        posted = _post(given, order, level, level > first).repartition(partition_count(spark), "key").sortWithinPartitions("key")
        got = write_table(posted.mapInArrow(merge, FOUND), "near")
        pairs = got.filter("b is not null").drop("key")
        out = pairs if out is None else out.unionByName(pairs)
        given = got.filter("b is null").select("key", F.col("a").alias("word"), F.col("a_n").alias("n"))
        if given.isEmpty():
            return out
        level += 1


# --- forms -----------------------------------------------------------------------------------

def variant_forms(words: DataFrame, near: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: form is its near word of largest n, of equal ones the
    first in code-point order, if that n is at least `times` the word's; root is where forms end. Counts grow along
    forms, so they end; roots are found by doubling, in as many rounds as the longest chain has binary digits."""
    both = near.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("m")).unionByName(
        near.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    led = -F.col("best.m") >= times * F.col("n")
    best = write_table(best.select("word", "n_near", F.when(led, F.col("best.other")).alias("form"), F.when(led, -F.col("best.m")).alias("form_n")), "forms")
    roots = best.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = write_table(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if roots.filter("moved").isEmpty():
            break
        roots = roots.drop("moved")
    out = words.join(best, "word", "left").join(roots.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, one_in: int = 97, letters: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """The words of the documents (word_counts) with their near words' number, forms and roots (variant_forms). An
    empty table has no words."""
    words = write_table(word_counts(docs, one_in, letters, least), "words")
    return variant_forms(words, near_pairs(words, min(LEVEL, letters - 1)), times)
