"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest of a set's 48-bit shingle hashes. Sketches merge (the k smallest of their union is
the union's sketch), and two of them estimate resemblance, containment and distinct counts. Sets of up to k
shingles are held whole, so their estimates are exact."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bytes_of, partition_count, shingle_hashes, small_batches, word_hashes, word_spans

BITS = 48
DIGITS = BITS // 4


def sketches(col: pa.Array, k: int, words: int) -> list[np.ndarray]:
    """The sketch of each text (null: empty): its k smallest distinct shingle hashes in order."""
    out = []
    buf, offs = bytes_of(col)
    for _, _, b, o in blocks(buf, offs):
        starts, ends, wo = word_spans(b, o)
        sh, so = shingle_hashes(word_hashes(b, starts, ends), wo, words)
        sh >>= np.uint64(64 - BITS)
        for i in range(len(o) - 1):
            x = sh[so[i]: so[i + 1]]
            if len(x) > 4 * k:  # repeats may push distinct hashes out: widen until k distinct ones are there
                m = 2 * k
                while True:
                    y = np.unique(np.partition(x, m - 1)[:m]) if m < len(x) else np.unique(x)
                    if len(y) >= k or m >= len(x):
                        break
                    m *= 4
                x = y
            else:
                x = np.unique(x)
            out.append(x[:k])
    return out


def to_text(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex() if DIGITS == 16 else "".join(map("%012x".__mod__, s.tolist()))


def from_text(t: str) -> np.ndarray:
    return np.array([int(t[i: i + DIGITS], 16) for i in range(0, len(t), DIGITS)], np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The sketch of the union of two parts."""
    return np.union1d(a, b)[:k]


def distinct_count(s: np.ndarray, k: int) -> float:
    """Distinct shingles: exact below k, else (k - 1) / the k-th smallest hash as a share of the range."""
    return float(len(s)) if len(s) < k else (k - 1) * 2.0**BITS / (float(s[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The Jaccard likeness of two sets: the share of the union's sketch that both hold. Two empty sets are
    alike (1); an empty and another set are not (0)."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    again = both[1:] == both[:-1]
    first = np.concatenate([[True], ~again])
    n = min(k, int(first.sum()))
    if len(both) == 0 or n == 0:
        return 0.0
    last = both[first][n - 1]
    return float((both[1:][again] <= last).sum()) / n


def containment(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The share of a's set that b's has, from resemblance and distinct counts; 0 for an empty a."""
    na, nb = distinct_count(a, k), distinct_count(b, k)
    if not na:
        return 0.0
    r = resemblance(a, b, k)
    return min(1.0, r * (na + nb) / (1 + r) / na)


def fingerprint(docs: DataFrame, k: int = 256, words: int = 5, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """`docs` with a fingerprint string of each text (k hashes of 12 hex digits at most; '' without words)."""
    from pyspark.sql.types import StringType, StructField, StructType

    small_batches(docs.sparkSession)
    docs = docs.drop(name) if name in docs.columns else docs
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([to_text(s) for s in sketches(b.column(at), k, words)], pa.string())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType())]))


def with_next(docs: DataFrame, run, schema: str) -> DataFrame:
    """Give each row together with the next one in ascending order of (doc_id, text), the first after the last.
    `run` gets iterators of batches (doc_id, text, bucket, own) in which rows are in order and a row with own
    false only ends its bucket. Buckets are ranges of doc_id, as many as the session has shuffle partitions at
    most, cut by a sample of 100 ids a bucket; the smallest row of each, one per bucket, is copied to the end of
    the bucket before. A null doc_id comes first; rows of one doc_id are in one bucket, by their texts."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    n_buckets = max(1, min(partition_count(spark), n // 8))
    ids = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"))
    seen = np.sort(ids.sample(min(1.0, 100 * n_buckets / n), 11).toArrow().column("i").to_numpy()) if n_buckets > 1 else np.zeros(0, np.int64)
    marks = np.unique(seen[np.arange(1, n_buckets) * len(seen) // n_buckets]) if len(seen) else seen

    @F.pandas_udf("long")
    def bucket(ids: pd.Series) -> pd.Series:  # how many cuts are at or below doc_id
        return pd.Series(np.searchsorted(marks, ids.to_numpy(np.int64), side="right"))

    docs = docs.withColumn("bucket", bucket(F.coalesce("doc_id", F.lit(-(1 << 63)))) if len(marks) else F.lit(0).cast("long"))
    # Smallest (doc_id, text) of each bucket: ids first, then the few texts that have them.
    low = docs.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("has_null"))
    lows = sorted((r["bucket"], None if r["has_null"] else r["low"]) for r in low.collect())
    if not lows:
        return spark.createDataFrame([], schema)
    heads = spark.createDataFrame([(b, d, lows[i - 1][0]) for i, (b, d) in enumerate(lows)], "hb long, hd long, before long")
    first = docs.join(F.broadcast(heads), (F.col("bucket") == F.col("hb")) & F.col("doc_id").eqNullSafe(F.col("hd"))) \
        .groupBy("before", "hb", "hd").agg(F.min("text").alias("text"))
    rows = docs.withColumn("own", F.lit(True)).unionByName(first.select(F.col("hd").alias("doc_id"), "text", F.col("before").alias("bucket"), F.lit(False).alias("own")))
    rows = rows.repartitionByRange(max(len(lows), 1), "bucket").sortWithinPartitions("bucket", F.col("own").desc(), F.col("doc_id").asc_nulls_first(), "text")
    return rows.select("doc_id", "text", "bucket", "own").mapInArrow(run, schema)


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def edit_report(docs: DataFrame, k: int = 256, words: int = 5) -> DataFrame:
    """Fingerprints of each text, of its edited text (edited_text with the next document's) and the likeness of
    its fingerprint to the edited text's and to the next document's. Null and empty texts have the fingerprint
    '' and are alike (1) to each other only. Repeated rows follow each other."""
    small_batches(docs.sparkSession, 200)

    def run(batches):
        held = None  # the last row: doc_id, text, sketch, bucket, own
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = list(zip(b.column(0).to_pylist(), texts, sketches(b.column(1), k, words), b.column(2).to_pylist(), b.column(3).to_pylist()))
            out, edited = [], []
            for row in rows:
                if held is not None and held[4] and held[3] == row[3]:
                    d, t, s, _, _ = held
                    e = edited_text(t, row[1])
                    edited.append(e)
                    out.append([d, len(t), hashlib.sha256(e.encode()).hexdigest(), s, row[2]])
                held = row
            es = sketches(pa.array(edited, pa.string()), k, words)
            cols = [[r[0] for r in out], [r[1] for r in out], [r[2] for r in out], [to_text(r[3]) for r in out], [to_text(e) for e in es],
                    [resemblance(r[3], e, k) for r, e in zip(out, es)], [resemblance(r[3], r[4], k) for r in out]]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
