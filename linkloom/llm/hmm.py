"""A hidden Markov language model of word sequences.

Word counts over all training texts give the emission classes: each of the most frequent words is a class, the
others share classes by their last bytes, within which a word's probability is its smoothed relative count.
Baum-Welch trains the states: every task adds up expected counts of its part of the corpus, Spark sums them,
and only tables of states x classes reach the driver. A scaled forward recursion over the whole sequence, the
end of text included, gives the exact likelihood of a text.

Counts of words below the broadcast table stay distributed: they are joined to the texts' rare words only. Every
word that is frequent in training texts is in the table; one that is frequent in other texts alone is a key with
many rows on the join's left side, which adaptive execution splits."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, state_key, worker_state, write_table

END = b"\n"  # the token after a text's words; no word has white space
STATES = 6
CLASSES = 8192  # frequent words that are classes of their own, the end included
SHARED = 512  # classes of all other words
TABLE = 65_536  # words whose counts are broadcast, at most
SEGMENT = 512  # tokens of a training sequence; scoring never cuts
PAIRS = 384  # classes in the pair statistics that start the training


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(texts: DataFrame, flush: int = 400_000) -> DataFrame:
    """(word binary, c long) over the rows of `texts` (text binary): each task's sums first, then Spark's."""
    def run(batches):
        seen: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(words_of(t))
            seen[END] += len(b)
            if len(seen) > flush:
                yield from out()
        yield from out()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def shared_class(word: bytes) -> int:
    return CLASSES + zlib.crc32(word[-3:]) % SHARED


class Model:
    """What workers need: the broadcast counts and classes, totals, and the states' parameters."""

    def __init__(self, top: list[tuple[bytes, int]], n: int, v: int, least: int, shared_n: np.ndarray, shared_v: np.ndarray):
        self.n, self.v, self.least = n, v, least
        self.words = [w for w, _ in top]
        self.counts = np.array([c for _, c in top], np.int64)
        self.shared_n, self.shared_v = shared_n, shared_v
        self.start = self.move = self.emit = None

    def lookup(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


def _frequent(counts: DataFrame) -> tuple[list[tuple[bytes, int]], int, int, int]:
    """The frequent words (all that occur `least` times or more, TABLE of them at most) with their counts, all
    tokens, distinct words, and `least`. A histogram of the counts' logarithms tells `least`, so that tasks send
    no more than the words that are kept."""
    per = counts.groupBy(F.floor(F.log2(F.col("c").cast("double")) * 64).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.min("c").alias("low")).collect()  # 64 rows for each doubling
    n, v = sum(r["n"] for r in per), sum(r["v"] for r in per)
    least, room = (1 << 62), TABLE
    for r in sorted(per, key=lambda r: -r["low"]):
        room -= r["v"]
        if room < 0:
            break
        least = r["low"]
    rows = counts.filter(F.col("c") >= least).collect()  # TABLE rows at most
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0])), n, v, least


def prepare(train: DataFrame) -> tuple[Model, DataFrame]:
    """Count the words of `train` (text binary): the model without states, and the counts as a written table."""
    counts = write_table(word_counts(train), "words")
    top, n, v, least = _frequent(counts)
    first = counts.sparkSession.createDataFrame([(bytearray(w),) for w, _ in top[:CLASSES]], "word binary")
    rest = counts.join(F.broadcast(first), "word", "left_anti")
    per = rest.groupBy((F.crc32(F.substring("word", -3, 3)) % SHARED).cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    shared_n, shared_v = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    for r in per:
        shared_n[r["k"]], shared_v[r["k"]] = r["n"], r["v"]
    return Model(top, n, v, least, shared_n, shared_v), counts


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """docs (key columns.., text binary last) as (key columns.., classes binary, n_tokens, n_known, base_score,
    inner_score, rare): base_score and inner_score (words within their shared classes) cover what the broadcast
    table knows, and rare holds the other words."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), state_key("encode")
    keys = docs.schema.fields[:-1]

    def state():
        m = shared.value
        known = m.lookup()
        base = np.log10((m.counts + 1.0) / (m.n + 1.0 * (m.v + 1)))
        inner = np.zeros(len(m.words))
        for i in range(min(CLASSES, len(m.words)), len(m.words)):
            k = shared_class(m.words[i]) - CLASSES
            inner[i] = np.log10((m.counts[i] + 1.0) / (m.shared_n[k] + 1.0 * (m.shared_v[k] + 1)))
        cls = np.array([i if i < CLASSES else shared_class(w) for i, w in enumerate(m.words)], np.uint16)
        return known, base, inner, cls

    def run(batches):
        known, base, inner, cls = worker_state(name, state)
        get = known.get
        end = get(END, -1)
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(len(keys)).to_pylist():
                words = words_of(t)
                ids = np.fromiter(map(get, words, [-1] * len(words)), np.int32, len(words))
                miss = np.flatnonzero(ids < 0)
                rare = [words[i] for i in miss.tolist()]
                ids = np.append(ids, end)
                ok = ids >= 0
                has = ids[ok]
                c = np.zeros(len(ids), np.uint16)
                c[ok] = cls[has]
                if len(rare):
                    c[miss] = [shared_class(w) for w in rare]
                if end < 0:
                    c[-1] = shared_class(END)
                for col, x in zip(cols, (c.tobytes(), len(ids), len(has), float(base[has].sum()), float(inner[has].sum()), rare)):
                    col.append(x)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *(pa.array(c, t) for c, t in zip(cols, types))], names=[*b.schema.names[: len(keys)], "classes", "n_tokens", "n_known", "base_score", "inner_score", "rare"])

    from pyspark.sql.types import StructType

    schema = StructType(list(keys)).simpleString()[7:-1]
    return docs.mapInArrow(run, schema + ",classes:binary,n_tokens:bigint,n_known:bigint,base_score:double,inner_score:double,rare:array<binary>")


# --- sequences in step ------------------------------------------------------------------------

def in_step(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lay sequences out by time: their order (longest first), the number still alive at each time, and where
    each time begins."""
    order = np.argsort(-lengths, kind="stable")
    long = lengths[order]
    alive = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), side="left")
    return order, alive, np.concatenate([[0], np.cumsum(alive)])


def by_time(tokens: np.ndarray, offs: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Tokens of sequences (given by offsets) in the layout of in_step."""
    lengths = np.diff(offs)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    t = np.arange(len(tokens)) - np.repeat(offs[:-1], lengths)
    out = np.empty_like(tokens)
    out[begin[t] + np.repeat(rank, lengths)] = tokens
    return out


def forward(tokens: np.ndarray, offs: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each sequence by the scaled forward recursion. emit is [class, state]."""
    lengths = np.diff(offs)
    order, alive, begin = in_step(lengths)
    tm = by_time(tokens, offs, order, begin)
    out = np.zeros(len(lengths))
    a = None
    for t, n in enumerate(alive.tolist()):
        e = emit[tm[begin[t]: begin[t] + n]]
        a = e * start if t == 0 else (a[:n] @ move) * e
        s = a.sum(1)
        a /= s[:, None]
        out[:n] += np.log(s)
    got = np.empty(len(lengths))
    got[order] = out
    return got


def expected_counts(tokens: np.ndarray, offs: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Baum-Welch's expected counts (starts, moves, emissions [class, state]) and the log likelihood."""
    k = len(start)
    order, alive, begin = in_step(np.diff(offs))
    tm = by_time(tokens, offs, order, begin)
    e = emit[tm].astype(np.float32)
    mv = move.astype(np.float32)
    alpha, scale = np.empty((len(tm), k), np.float32), np.empty(len(tm), np.float32)
    for t, n in enumerate(alive.tolist()):
        at = begin[t]
        x = e[at: at + n] * start.astype(np.float32) if t == 0 else (alpha[begin[t - 1]: begin[t - 1] + n] @ mv) * e[at: at + n]
        s = x.sum(1)
        scale[at: at + n] = s
        alpha[at: at + n] = x / s[:, None]
    moves = np.zeros((k, k))
    beta = np.ones((0, k), np.float32)
    for t in range(len(alive) - 1, -1, -1):
        at, n = begin[t], alive[t]
        m = len(beta)
        nb = np.ones((n, k), np.float32)
        if m:
            nxt = begin[t + 1]
            y = e[nxt: nxt + m] * beta / scale[nxt: nxt + m, None]
            moves += alpha[at: at + m].T @ y
            nb[:m] = y @ mv.T
        beta = nb
        alpha[at: at + n] *= nb  # now the state probabilities
    gamma = alpha
    emissions = np.stack([np.bincount(tm, weights=gamma[:, j], minlength=len(emit)) for j in range(k)], 1)
    return gamma[: alive[0] if len(alive) else 0].sum(0).astype(float), moves * move, emissions, float(np.log(scale).sum())


def _sequences(column, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a binary column, and offsets of its sequences, cut to `most` tokens where that is given."""
    vals = column.to_pylist()
    tokens = np.frombuffer(b"".join(vals), np.uint16).astype(np.int64)
    offs = np.concatenate([[0], np.cumsum([len(v) // 2 for v in vals])])
    if most:
        offs = np.unique(np.concatenate([np.arange(a, b, most) for a, b in zip(offs[:-1], offs[1:])] + [offs[-1:]]))
    return tokens, offs


def _pair_start(coded: DataFrame, model: Model, size: int) -> np.ndarray:
    """Starting emissions [class, state] from counts of adjacent classes over all training texts: a mixture of
    STATES independent pairs is fitted to the table of the most frequent classes."""
    def run(batches):
        total = np.zeros(PAIRS * PAIRS, np.int64)
        for b in batches:
            tokens, offs = _sequences(b.column(0), None)
            if len(tokens) > 1:
                inside = np.ones(len(tokens) - 1, bool)
                inside[offs[1:-1] - 1] = False
                x, y = tokens[:-1][inside], tokens[1:][inside]
                ok = (x < PAIRS) & (y < PAIRS)
                total += np.bincount(x[ok] * PAIRS + y[ok], minlength=PAIRS * PAIRS)
        h = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int32)), pa.array(total[h])], names=["h", "n"])

    got = coded.select("classes").mapInArrow(run, "h int, n long").groupBy("h").agg(F.sum("n").alias("n")).toArrow()
    x = np.zeros(PAIRS * PAIRS)
    x[got.column("h").to_numpy()] = got.column("n").to_numpy()
    x = x.reshape(PAIRS, PAIRS)
    x = x + x.T
    rng = np.random.default_rng(3)
    whole = (x.sum(1) + 0.1) / (x.sum(1) + 0.1).sum()
    b = whole[:, None] * rng.uniform(0.5, 1.5, (PAIRS, STATES))
    b /= b.sum(0)
    w = np.full(STATES, 1 / STATES)
    for _ in range(80):
        fit = (b * w) @ b.T + 1e-300
        r = x / fit
        new = b * w * (r @ b)
        w = new.sum(0) + 1e-9
        b = (new + 1e-3 * whole[:, None]) / (w + 1e-3)
        b /= b.sum(0)
        w /= w.sum()
    unigram = np.full(size, 0.5)
    unigram[: min(CLASSES, len(model.counts))] += model.counts[:CLASSES]
    unigram[CLASSES:] += model.shared_n
    unigram /= unigram.sum()
    emit = np.repeat(unigram[:, None], STATES, 1)
    emit[:PAIRS] = b * unigram[:PAIRS].sum()
    return emit / emit.sum(0)


def fit(coded: DataFrame, model: Model, rounds: int = 3) -> Model:
    """Train start, move and emit by Baum-Welch over all rows of `coded` (classes). Sequences are cut into
    segments of SEGMENT tokens for training. Emissions are smoothed by the corpus's unigrams, so that every
    class has a probability in every state."""
    size = CLASSES + SHARED
    emit = _pair_start(coded, model, size)
    start = np.full(STATES, 1 / STATES)
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    unigram = np.full(size, 0.5)
    unigram[: min(CLASSES, len(model.counts))] += model.counts[:CLASSES]
    unigram[CLASSES:] += model.shared_n
    unigram /= unigram.sum()
    for _ in range(rounds):
        shared = coded.sparkSession.sparkContext.broadcast((start, move, emit))

        def run(batches, shared=shared):
            start, move, emit = shared.value
            total = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((size, STATES))]
            held: list = []

            def add():
                tokens, offs = _sequences(pa.chunked_array(held), SEGMENT)
                if len(tokens):
                    for x, y in zip(total, expected_counts(tokens, offs, start, move, emit)):
                        x += y
                held.clear()

            n = 0
            for b in batches:
                held.append(b.column(0))
                n += b.nbytes // 2
                if n > 700_000:
                    add()
                    n = 0
            if held:
                add()
            flat = np.concatenate([t.ravel() for t in total])
            h = np.flatnonzero(flat > 1e-6)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int32)), pa.array(flat[h])], names=["h", "x"])

        got = coded.select("classes").mapInArrow(run, "h int, x double").groupBy("h").agg(F.sum("x").alias("x")).toArrow()
        flat = np.zeros(STATES + STATES**2 + size * STATES)
        flat[got.column("h").to_numpy()] = got.column("x").to_numpy()
        start = flat[:STATES] + 0.1
        start /= start.sum()
        move = flat[STATES: STATES + STATES**2].reshape(STATES, STATES) + 0.1
        move /= move.sum(1, keepdims=True)
        emit = flat[STATES + STATES**2:].reshape(size, STATES) + 20 * unigram[:, None]
        emit /= emit.sum(0)
    model.start, model.move, model.emit = start, move, emit
    return model


def score(docs: DataFrame, train: str = "train", rounds: int = 3) -> DataFrame:
    """Train on the rows of `docs` (doc_id, text, and a boolean column `train`) and score all: (doc_id, the train
    column, n_tokens, n_known, train_tokens, base_score, score). base_score is the smoothed unigram log10
    probability, score the model's. A null text is empty and has one token, its end; repeated rows are scored
    each; without training rows every word is equally unlikely."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.col(train).alias("train"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    model, counts = prepare(rows.filter("train").select("text"))
    coded = write_table(encode(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "train", "text"), model), "coded")
    model = fit(coded.filter("train"), model, rounds)
    shared = spark.sparkContext.broadcast((model.start, model.move, model.emit))

    def run(batches):
        start, move, emit = shared.value
        held: list = []
        n = 0

        def out():
            t = pa.Table.from_batches(held)
            tokens, offs = _sequences(t.column("classes"), None)
            s = forward(tokens, offs, start, move, emit) / np.log(10)
            yield from t.drop_columns(["classes"]).append_column("states_score", pa.array(s)).combine_chunks().to_batches()
            held.clear()

        for b in batches:
            held.append(b)
            n += b.nbytes // 2
            if n > 1_500_000:
                yield from out()
                n = 0
        if held:
            yield from out()

    scored = coded.select("row", "doc_id", "train", "n_tokens", "n_known", "base_score", "inner_score", "classes").mapInArrow(
        run, "row long, doc_id long, train boolean, n_tokens long, n_known long, base_score double, inner_score double, states_score double")
    # Words below the broadcast table: one row per text and word, joined to their counts.
    rare = coded.select("row", F.explode("rare").alias("word"))
    low = counts.filter(F.col("c") < model.least)
    sizes = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(zip(model.shared_n, model.shared_v))], "k int, sn long, sv long")
    met = rare.join(low, "word", "left").select("row", F.coalesce("c", F.lit(0)).alias("c"), (F.crc32(F.substring("word", -3, 3)) % SHARED).cast("int").alias("k")) \
        .join(F.broadcast(sizes), "k")
    base = F.log10((F.col("c") + 1) / F.lit(float(model.n + model.v + 1)))
    inner = F.log10((F.col("c") + 1) / (F.col("sn") + F.col("sv") + 1))
    per = met.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("k2"), F.sum(base).alias("b2"), F.sum(inner).alias("i2"))
    none = F.lit(0.0)
    return scored.join(per, "row", "left").select(
        "doc_id", F.col("train").alias(train), "n_tokens", (F.col("n_known") + F.coalesce("k2", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b2", none)).alias("base_score"), (F.col("states_score") + F.col("inner_score") + F.coalesce("i2", none)).alias("score"))
