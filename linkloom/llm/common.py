"""Helpers that the operators of this subpackage share: tables in the shared folder, Arrow batches,
numpy hashing of words and shingles, and connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# --- Spark side -------------------------------------------------------------------------------

def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: `spark.checkpoint.dir` of the session. Where that is unset a local session
    (tests) gets a temporary folder, made once; on a cluster it is an error."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("linkloom.shared.dir", None)
    if not got:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        got = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("linkloom.shared.dir", got)
    return got.rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linkloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver's collector finds their plans unused; without this they pile up on the
    executors' disks over an operator's many steps. Memory that the driver's own Python has freed goes back too."""
    give_back()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound Arrow batches by rows, for tables with long texts, and let workers import this package from where
    the driver has it, where they can reach that folder (elsewhere it is installed)."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def crc_mod(col, m: int):
    """crc32 of a column's text form, modulo m; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


def partition_count(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --- texts to words ---------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M64 = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
BLOCK = 1 << 20  # bytes of text handled at once
RUN = 1 << 16  # bytes whose words are hashed at once


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_SEATS = mix(np.arange(1001, 1065, dtype=np.uint64) * np.uint64(_STEP)) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, RUN + 1)
        for i, m in enumerate((_STEP, _BACK)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def bytes_of(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array, and each row's offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset: col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0]: offs[-1]], offs - offs[0]


def blocks(buf: np.ndarray, offs: np.ndarray, most: int = BLOCK):
    """Split rows into runs of about `most` bytes: yields first row, end row, bytes, offsets."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, buf[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of each row, and each row's offsets into them."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~_SPACE[buf]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    cut = offs[(offs > 0) & (offs < n)]
    begin[cut] |= word[cut]
    end[cut - 1] |= word[cut - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z in lower case, by differences of one running sum."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        # Runs of words of about RUN bytes: the 64-bit numbers of a very long text are never in memory at once.
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + RUN, "right")))
        at = starts[i]
        part, s, e = buf[at: ends[j - 1]], starts[i:j] - at, ends[i:j] - at
        p, q = _power_tables(len(part) + 1)
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[part]] * p[:-1], out=run[1:])
        out[i:j] = mix((run[e] - run[s]) * q[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingle_hashes(words: np.ndarray, woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row and the rows' offsets into them. A row of fewer words has
    one shingle, the whole sequence; a row without words has none."""
    counts = np.diff(woffs)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    soffs = np.concatenate([[0], np.cumsum(per)])
    first = np.repeat(woffs[:-1] - soffs[:-1], per) + np.arange(soffs[-1])
    long = np.minimum(np.repeat(counts, per), k).astype(np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    short = bool((counts[counts > 0] < k).any())
    acc = long * np.uint64(_STEP)
    for j in range(k):
        term = padded[first + j] * _SEATS[j]
        if short:
            term[long <= j] = 0
        acc += term
    return mix(acc), soffs


def shingle_sets(col: pa.Array, k: int):
    """For each row in turn: the sorted distinct shingle hashes of its text."""
    buf, offs = bytes_of(col)
    for _, _, b, o in blocks(buf, offs):
        starts, ends, wo = word_spans(b, o)
        sh, so = shingle_hashes(word_hashes(b, starts, ends), wo, k)
        for i in range(len(o) - 1):
            yield np.unique(sh[so[i]: so[i + 1]])


def state_key(name: str) -> str:
    """A key for worker_state that no other call gives: made on the driver, once for each model or broadcast. (An
    address made in a worker may come back with another broadcast's values.)"""
    return f"{name} {uuid.uuid4().hex}"


def worker_state(key: str, make):
    """An object of this Python worker, made once."""
    cache = _STATES
    if key not in cache:
        empty_worker()
        cache[key] = make()
    return cache[key]


_STATES: dict = {}


def empty_worker() -> None:
    """Drop what other operators keep in this Python worker, and give freed memory back to the machine: workers
    live on through an application."""
    _STATES.clear()
    give_back()


def give_back() -> None:
    """Freed memory goes back to the machine: C's and Arrow's allocators hold on to what was taken once."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not GNU's C library
        pass


class WordCache(dict):
    """Words to ids, as bytes of 32-bit little-endian numbers. A word that isn't there comes from the older
    generation, or gets a number from OPEN on in place of its ids, and is noted in `new`."""

    OPEN = 1 << 31

    def __init__(self, before: dict):
        super().__init__()
        self.before, self.new = before, []

    def __missing__(self, word):
        ids = self.before.get(word)
        if ids is None:
            ids = (self.OPEN + len(self.new)).to_bytes(4, "little")
            self.new.append(word)
        self[word] = ids
        return ids

    def filled(self, raw: bytes, got: list[bytes]) -> bytes:
        """`raw` with the ids of new words, `got`, where their numbers stand."""
        ids = np.frombuffer(raw, "<u4")
        at = np.flatnonzero(ids >= self.OPEN)
        parts, begin = [], 0
        for j, k in zip((4 * at).tolist(), (ids[at] - np.uint32(self.OPEN)).tolist()):
            parts += (raw[begin:j], got[k])
            begin = j + 4
        parts.append(raw[begin:])
        return b"".join(parts)


def ids_of_texts(texts, split, cache: WordCache, learn, most_new: int = 1 << 15) -> list[bytes]:
    """The ids of texts (joined over the words that split() gives); learn() gets the list of new words and returns
    their ids, which are kept, after every `most_new` of them."""
    out: list[bytes] = []
    late: list[int] = []
    get, new = cache.__getitem__, cache.new

    def settle() -> None:
        got = learn(new)
        cache.update(zip(new, got))
        new.clear()
        for i in late:
            out[i] = cache.filled(out[i], got)
        late.clear()

    for t in texts:
        n = len(new)
        out.append(b"".join(map(get, split(t))))
        if n or len(new) > n:  # it may also have words that are new since an earlier text
            late.append(len(out) - 1)
            if len(new) > most_new:
                settle()
    if late:
        settle()
    return out


# --- connected components ---------------------------------------------------------------------

def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of `edges` (a, b long) by alternating large-star and small-star steps, each
    written to the shared folder: (id, component_id), the smallest id reachable; ids without an edge are
    absent. Nothing but one count per round reaches the driver. Minima are partial aggregates; the star steps are
    joins with one row a node on one side, and adaptive execution splits a hub's many rows on the other."""
    spark = edges.sparkSession
    e = write_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if e.isEmpty():
        return spark.createDataFrame([], "id long, component_id long")
    last = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: neighbours greater than a node are linked to the node's smallest neighbour.
        large = e.select(F.col("v").alias("w"), F.col("u").alias("x")).join(low.withColumnRenamed("u", "w"), "w") \
            .select(F.col("x").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Small star: a node's smaller neighbours are linked to its smallest one.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")) \
            .select("s.u", "s.v").filter("u <> v").distinct()
        e = write_table(small, "edges")
        state = tuple(e.agg(F.count("*"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
