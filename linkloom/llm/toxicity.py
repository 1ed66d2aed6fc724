"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, hashed into a table of vectors; a text is the scaled
average of its words; a softmax over two classes follows. Vectors and softmax are trained jointly in numpy, so
a misspelling never seen shares the vectors of its n-grams. Since nothing after the vectors is other than
linear, a word's share in the result is one number, which workers keep in a bounded cache."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import give_back, mix, small_batches, state_key, word_hashes, worker_state

TABLE = 1 << 17
DIM = 6
SIZES = (3, 4, 5)
#: Documents longer than this count as this long when words are averaged, so one insult in a long text weighs.
EVEN = 40.0
STEPS = 600


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words' n-grams (with marks at both ends) and of the words, and the words' offsets."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    buf = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(n)
    starts = ends - n
    owner = np.repeat(np.arange(len(words)), n)
    rows, own = [word_hashes(buf, starts, ends) % np.uint64(TABLE)], [np.arange(len(words))]
    for k in SIZES:
        place = np.arange(len(buf))
        place = place[place + k <= ends[owner]]
        rows.append(mix(word_hashes(buf, place, place + k) + np.uint64(k)) % np.uint64(TABLE))
        own.append(owner[place])
    rows, own = np.concatenate(rows).astype(np.int64), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return rows[order], np.searchsorted(own[order], np.arange(len(words) + 1))


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of a text's subwords and their shares in its average."""
    words, n = np.unique(np.array(_words(text), object), return_counts=True) if text.strip() else (np.zeros(0, object), np.zeros(0))
    rows, at = subwords(words.tolist())
    per = np.diff(at)
    share = np.repeat(n / (per * np.sqrt(EVEN * max(n.sum(), 1))), per)
    key, inv = np.unique(rows, return_inverse=True)
    return key.astype(np.int32), np.bincount(inv, weights=share, minlength=len(key)).astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, epochs: int | None = None, batch: int = 64, seed: int = 5) -> dict:
    """Fit vectors and softmax together by Adam with weights that even out the classes. Unless epochs are given they
    are about STEPS steps, from 6 to 60 times over the texts. Without both classes the model is a constant."""
    epochs = epochs or int(np.clip(-(-STEPS * batch // max(1, len(texts))), 6, 60))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.05, (TABLE, DIM)).astype(np.float32)
    soft = np.zeros((DIM, 2), np.float32)
    soft[:, 1] = rng.normal(0, 1, DIM)
    soft[:, 0] = -soft[:, 1]
    bias = np.zeros(2, np.float32)
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return {"vectors": np.zeros(TABLE, np.float32), "bias": (4.0 if len(labels) and labels[0] else -4.0)}
    bags = [_bag(t) for t in texts]
    weight = len(labels) / (2.0 * np.bincount(labels, minlength=2))[labels]
    m1, m2 = np.zeros_like(vectors), np.zeros_like(vectors)
    s1, s2 = np.zeros((DIM + 1, 2)), np.zeros((DIM + 1, 2))
    step = 0
    for epoch in range(epochs):
        rate = np.float32(0.03 * (1 - epoch / epochs) + 0.003)
        order = rng.permutation(len(bags))
        for b in range(0, len(order), batch):
            ids = order[b: b + batch]
            step += 1
            flat = np.concatenate([bags[i][0] for i in ids])
            share = np.concatenate([bags[i][1] for i in ids])
            own = np.repeat(np.arange(len(ids)), [len(bags[i][0]) for i in ids])
            doc = np.stack([np.bincount(own, weights=vectors[flat, d] * share, minlength=len(ids)) for d in range(DIM)], 1)
            z = doc @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ids)), labels[ids]] -= 1
            g = p * (weight[ids] / len(ids))[:, None]
            back = (g @ soft.T).astype(np.float32)
            gs = np.concatenate([doc.T @ g, g.sum(0, keepdims=True)])
            s1 += 0.1 * (gs - s1)
            s2 += 0.001 * (gs * gs - s2)
            move = 0.3 * rate * (s1 / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.999**step)) + 1e-8)
            gv = np.stack([np.bincount(flat, weights=back[own, d] * share, minlength=TABLE) for d in range(DIM)], 1).astype(np.float32)
            # Adam for the rows met in this batch; the others keep still.
            met = np.flatnonzero(np.bincount(flat, minlength=TABLE))
            x = gv[met]
            m1[met] += np.float32(0.1) * (x - m1[met])
            m2[met] += np.float32(0.001) * (x * x - m2[met])
            vectors[met] -= rate * (m1[met] / np.float32(1 - 0.9**step)) / (np.sqrt(m2[met] / np.float32(1 - 0.999**step)) + np.float32(1e-7))
            soft -= move[:DIM]
            bias -= move[DIM]
    return {"vectors": (vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), "bias": float(bias[1] - bias[0])}


def word_margins(words: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Each word's share in the difference of the two classes."""
    rows, at = subwords(words)
    return np.add.reduceat(vectors[rows], at[:-1]) / np.diff(at) if words else np.zeros(0)


def margins(texts: list[bytes], model: dict, cache: dict, most: int = 400_000) -> np.ndarray:
    """The log odds of the toxic class for each text."""
    split = [_words(t) for t in texts]
    missing: set[bytes] = set()
    for ws in split:
        missing.update(w for w in set(ws) if w not in cache)
    if len(cache) + len(missing) > most:
        cache.clear()
        missing = set().union(*map(set, split))
    new = list(missing)
    cache.update(zip(new, word_margins(new, model["vectors"]).tolist()))
    get = cache.__getitem__
    return np.array([sum(map(get, ws)) / max(1.0, (EVEN * len(ws)) ** 0.5) for ws in split]) + model["bias"]


def _smallest(ids: DataFrame, most: int) -> list[tuple[int, int]]:
    """(i, y) of the `most` smallest hashes h of each y. Hashes are even, so a bound leaves about as many rows: what
    tasks send is that, however many tasks there are; should the bound leave too few, all are asked."""
    out = []
    for y, n in sorted((r["y"], r["count"]) for r in ids.groupBy("y").count().collect()):
        part, share = ids.filter(F.col("y") == y), (most + 10 * most ** 0.5 + 50) / n
        near = part.filter(F.col("h") <= int(share * 2.0 ** 64) - (1 << 63)) if share < 0.5 else part
        for rows in (near, part):
            got = rows.orderBy("h", "i").limit(most).collect()
            if len(got) == min(most, n):
                break
        out += [(r["i"], r["y"]) for r in got]
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 3000, id_col: str = "doc_id", text: str = "text") -> dict:
    """Train on a bounded sample of labelled rows: at most `most` documents of each class, those whose ids have
    the smallest hashes, one text of each id. A document labelled more than once is toxic if any label says so; null labels and
    labels without a document teach nothing."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    rows = _smallest(ids.withColumn("h", F.xxhash64("i")), most)
    if not rows:
        return train([], np.zeros(0))
    chosen = F.broadcast(spark.createDataFrame(rows, "i long, y int"))
    got = docs.join(chosen, F.col(id_col) == F.col("i")).groupBy("i", "y").agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("t")).toArrow().sort_by([("i", "ascending"), ("t", "ascending")])
    texts, y = [t.encode() for t in got.column("t").to_pylist()], got.column("y").to_numpy()
    del got
    model = train(texts, y)
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: dict, threshold: float = 0.7, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (of its columns those in `keep`, else all) with score double, the probability of the toxic class,
    and predicted int, 1 from `threshold` on. A null or empty text scores by the bias alone. Columns of these
    names are replaced; repeated rows are each scored alike."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shared, state = docs.sparkSession.sparkContext.broadcast(model), state_key("toxicity")
    at = docs.columns.index(text)
    out = [i for i, c in enumerate(docs.columns) if keep is None or c in keep]

    def run(batches):
        cache = worker_state(state, dict)
        for b in batches:
            z = margins([t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()], shared.value, cache)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in out), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*(b.schema.names[i] for i in out), "score", "predicted"])

    return docs.mapInArrow(run, StructType([*(docs.schema.fields[i] for i in out), StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
