"""Language identification by multilingual mixture inference.

Training counts hashed byte n-grams per language. A text is cut into short runs of bytes; each run has a
likelihood under every language, and expectation-maximisation over the runs estimates the text's language
proportions. The set of languages is selected by penalised likelihood: starting from the best single language,
one is added only while the gain in log likelihood exceeds the penalty."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from .common import blocks, bytes_of, empty_worker, small_batches

BUCKETS = 1 << 16
RUN = 48  # bytes in a run
#: An n-gram is seen in its neighbours too; the runs' log likelihoods are scaled down by this.
SCALE = 0.3
PENALTY = 6.0
UNKNOWN = "und"

# Bytes by class: letters of ASCII in lower case, bytes above 127 as they are, all others one separator.
_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


def grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the three and of the four bytes that end at each place (padded by separators)."""
    c = np.concatenate([np.zeros(3, np.uint32), _CLASS[buf]])
    three = (c[1:-2] * np.uint32(155) + c[2:-1]) * np.uint32(155) + c[3:]
    four = three * np.uint32(2654435761) + c[:-3] * np.uint32(40503) * np.uint32(65599)
    three = three * np.uint32(2246822519)
    return (three >> np.uint32(17)).astype(np.int32), ((four >> np.uint32(17)) + np.uint32(BUCKETS // 2)).astype(np.int32)


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Count n-grams of every row with a language: the languages in order, and log probabilities [bucket,
    language]. The counts of each task are summed by Spark; BUCKETS x languages numbers reach the driver."""
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        empty_worker()
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for v in dict.fromkeys(langs.tolist()):
                buf, offs = bytes_of(b.column(1).filter(pa.array(langs == v)))
                got = total.setdefault(v, np.zeros(BUCKETS, np.int64))
                for _, _, x, _ in blocks(buf, offs):
                    for g in grams(x):
                        got += np.bincount(g, minlength=BUCKETS)
        for v, n in total.items():
            h = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(h), pa.string()), pa.array(h.astype(np.int32)), pa.array(n[h])], names=["lang", "h", "n"])

    got = rows.mapInArrow(count, "lang string, h int, n long").groupBy("lang", "h").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    n = np.zeros((BUCKETS, len(names)))
    if names:
        n[got.column("h").to_numpy(), np.searchsorted(np.array(names, object), np.array(got.column("lang").to_pylist(), object))] = got.column("n").to_numpy()
    return names, np.log((n + 0.5) / (n.sum(0) + 0.5 * BUCKETS)).astype(np.float32)


def run_likelihoods(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled log likelihoods [run, language] of the runs of each row, and the rows' offsets into them. Places
    where all bytes of an n-gram are separators say nothing."""
    per = -(-np.diff(offs) // RUN)
    roffs = np.concatenate([[0], np.cumsum(per)])
    first = np.repeat(offs[:-1] - roffs[:-1] * RUN, per) + np.arange(roffs[-1]) * RUN
    out = np.zeros((len(first), table.shape[1]), np.float32)
    if len(first):
        three, four = grams(buf)
        dull = three == 0
        for j in range(table.shape[1]):
            col = np.ascontiguousarray(table[:, j])
            x = col[three] + col[four]
            x[dull] = 0
            out[:, j] = np.add.reduceat(x, first)
    return out * SCALE, roffs


def _rows(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows' runs; every row has one run at least."""
    return np.add.reduceat(x, at[:-1], axis=0)


def proportions(ll: np.ndarray, at: np.ndarray, allowed: np.ndarray, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """EM for each row's proportions over its allowed languages: proportions and log likelihood."""
    n = np.diff(at)
    top = ll.max(1, keepdims=True)
    like = np.exp(ll - top)
    theta = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    for _ in range(steps):
        r = like * np.repeat(theta, n, axis=0)
        r /= r.sum(1, keepdims=True) + 1e-300
        theta = _rows(r, at) / n[:, None]
    mass = (like * np.repeat(theta, n, axis=0)).sum(1, keepdims=True)
    return theta, _rows(np.log(mass + 1e-300) + top, at)[:, 0]


def infer(ll: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the main language's number, its score, and the proportions. The score is the language's
    proportion, or in a text of one language its probability against the other languages alone."""
    ll = ll.astype(np.float64)
    n_rows, n_langs = len(at) - 1, ll.shape[1]
    alone = _rows(ll, at)
    best = alone.argmax(1)
    p = np.exp(alone - alone.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    allowed = np.zeros((n_rows, n_langs))
    allowed[np.arange(n_rows), best] = 1
    theta, value = allowed.copy(), alone.max(1)
    # All languages together bound what any set can gain; most rows stop here.
    open_ = np.flatnonzero(np.diff(at) > 1)
    for size in range(2, n_langs + 1):
        if not len(open_):
            break
        keep = np.concatenate([np.arange(at[i], at[i + 1]) for i in open_]) if len(open_) < n_rows else np.arange(at[-1])
        sub, sat = ll[keep], np.concatenate([[0], np.cumsum(np.diff(at)[open_])])
        everything, bound = proportions(sub, sat, np.ones((len(open_), n_langs)))
        can = bound - value[open_] > PENALTY
        if not can.any():
            break
        everything[allowed[open_] > 0] = -1
        add = everything.argmax(1)
        trial = allowed[open_].copy()
        trial[np.arange(len(open_)), add] = 1
        got, v = proportions(sub, sat, trial)
        take = can & (v - value[open_] > PENALTY)
        rows = open_[take]
        allowed[rows], theta[rows], value[rows] = trial[take], got[take], v[take]
        open_ = rows
    main = theta.argmax(1)
    score = theta[np.arange(n_rows), main]
    one = allowed.sum(1) == 1
    score[one] = p[np.arange(n_rows), main][one]
    return main, score, theta


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (of its columns those in `keep`, else all) with lang_pred, lang_score (0 to 1) and n_langs, the
    size of the selected set. A null text, one without a letter, or a model without languages gives `und`,
    score 0 and 0 languages. Columns of these names are replaced; repeated rows are each answered alike."""
    small_batches(docs.sparkSession)
    new = ["lang_pred", "lang_score", "n_langs"]
    docs = docs.drop(*new)
    names, table = model
    shared = docs.sparkSession.sparkContext.broadcast((names, table))
    at = docs.columns.index(text)
    out = [i for i, c in enumerate(docs.columns) if keep is None or c in keep]

    def run(batches):
        empty_worker()
        names, table = shared.value
        for b in batches:
            texts = b.column(at)
            n = len(texts)
            pred, score, size = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int32)
            buf, offs = bytes_of(texts)
            letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
            for i, j, x, o in blocks(buf, offs) if names else ():
                ok = letters[i:j]
                ll, roffs = run_likelihoods(x, o, table)
                if not ok.any():
                    continue
                runs = np.repeat(ok, np.diff(roffs))
                main, s, theta = infer(ll[runs], np.concatenate([[0], np.cumsum(np.diff(roffs)[ok])]))
                for k, m, v, t in zip((i + np.flatnonzero(ok)).tolist(), main, s, (theta > 0).sum(1)):
                    pred[k], score[k], size[k] = names[m], v, t
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in out), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(size)], names=[*(b.schema.names[i] for i in out), *new])

    fields = [docs.schema.fields[i] for i in out]
    return docs.mapInArrow(run, StructType([*fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("n_langs", IntegerType())]))
