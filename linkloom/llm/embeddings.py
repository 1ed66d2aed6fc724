"""Near-duplicate embeddings by cross-polytope hashing.

A table hashes a vector with some pseudo-random rotations (random signs and a fast Hadamard transform, three
times each), more of them the more vectors there are: each gives the axis, with its sign, nearest to the rotated
vector. Multiprobe puts a vector also into the buckets of the nearest misses. Vectors that share a bucket are compared exactly; a pair counts in the
first bucket it shares. Equal vectors are one class with a weight, so copies never meet pairwise."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix, small_batches, write_table

PROBES = 3
CHUNK = 512
MISS = 1e-4  # the share of pairs at the threshold that may be in no common bucket


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows whose length is a power of two, unscaled."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


def settings(n: int, size: int, threshold: float) -> tuple[int, int]:
    """Hashes of a table's key, and tables, for n vectors. Keys have as many values as there are vectors at least, so
    buckets don't fill up as n grows; tables are as many as leave MISS of the pairs at the threshold apart, by what
    made-up pairs of that cosine share."""
    d = 1 << max(1, int(np.ceil(np.log2(max(2, size)))))
    hashes = max(2, int(np.ceil(np.log(max(n, 2)) / np.log(2 * d))))
    rng = np.random.default_rng(5)
    x, r = rng.normal(size=(2, 400, max(2, size)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r -= (r * x).sum(1, keepdims=True) * x
    r /= np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * r
    a, b = buckets(x, hashes, 8), buckets(y, hashes, 8)
    met = float((a[:, :, :, None] == b[:, :, None, :]).any((2, 3)).mean())
    return hashes, int(np.clip(np.ceil(np.log(MISS) / np.log(max(1e-9, 1 - min(met, 0.95)))), 4, 120))


def buckets(x: np.ndarray, hashes: int, tables: int, seed: int = 11) -> np.ndarray:
    """Bucket keys [row, table, probe] of unit vectors; the number of the table is in a key."""
    rng = np.random.default_rng(seed)
    d = 1 << max(1, int(np.ceil(np.log2(max(2, x.shape[1])))))
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    out = np.zeros((len(x), tables, PROBES), np.int64)
    rows = np.arange(len(x))
    for t in range(tables):
        first, second, gap = [], [], []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d)) / np.sqrt(d)
            a = np.abs(y)
            two = np.argpartition(a, d - 2, axis=1)[:, d - 2:]
            flip = a[rows, two[:, 0]] > a[rows, two[:, 1]]
            i, j = np.where(flip, two[:, 0], two[:, 1]), np.where(flip, two[:, 1], two[:, 0])
            first.append(2 * i + (y[rows, i] < 0))
            second.append(2 * j + (y[rows, j] < 0))
            gap.append(a[rows, i] - a[rows, j])
        first, second, gap = np.stack(first, 1), np.stack(second, 1), np.stack(gap, 1)
        near = np.argsort(gap, axis=1, kind="stable")
        for p in range(PROBES):
            code = first.copy()
            if p:
                k = near[:, (p - 1) % hashes]
                code[rows, k] = second[rows, k]
            key = np.full(len(x), t, np.uint64)
            for h in range(hashes):
                key = key * np.uint64(2 * d + 1) + code[:, h].astype(np.uint64)
            out[:, t, p] = ((mix(key) >> np.uint64(8)) | (np.uint64(t) << np.uint64(56))).view(np.int64)
    return out


def _classes(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, key, vec): each vector's digest and its components as bytes of doubles; null for one that links
    with nothing."""
    def run(batches):
        import hashlib

        for b in batches:
            keys, vecs = [], []
            for v in b.column(1).to_pylist():
                x = np.array(v, np.float64) if v and None not in v else None
                if x is None or not np.isfinite(x).all() or not x.any():
                    keys.append(None)
                    vecs.append(None)
                else:
                    x = x + 0.0  # minus zero is zero
                    keys.append(hashlib.md5(x.tobytes()).digest())
                    vecs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "key", "vec"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>")).mapInArrow(run, "vec_id long, key binary, vec binary")


def _hashed(reps: DataFrame, hashes: int, tables: int) -> DataFrame:
    """reps (id, m, vec) with their bucket keys."""
    def run(batches):
        for b in batches:
            vecs = b.column(2).to_pylist()
            keys: list = [None] * len(vecs)
            for size in set(map(len, vecs)):
                at = [i for i, v in enumerate(vecs) if len(v) == size]
                x = np.frombuffer(b"".join(vecs[i] for i in at), np.float64).reshape(len(at), -1)
                x = x / np.abs(x).max(1, keepdims=True)
                k = buckets(x / np.linalg.norm(x, axis=1, keepdims=True), hashes, tables)
                k = mix(k.view(np.uint64) ^ np.uint64(size)) >> np.uint64(8) | (np.arange(tables, dtype=np.uint64)[None, :, None] << np.uint64(56))
                for i, row in zip(at, k.reshape(len(at), -1).view(np.int64)):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.list_(pa.int64()))], names=["id", "m", "vec", "keys"])

    return reps.mapInArrow(run, "id long, m long, vec binary, keys array<bigint>")


def _links(ids, m, x, keys, key, group, threshold):
    """Of one bucket's rows: each row's weight of linked rows that it first meets here, and the smallest id that
    it reaches over those links. group tells which chunk of two a row is in (-1: both are the same)."""
    n = len(ids)
    table = int(key) >> 56
    total, label = np.zeros(n, np.int64), ids.copy()
    la, lb = [], []
    for at in range(0, n, 256):
        i, j = np.nonzero(x[at: at + 256] @ x.T >= threshold)
        i += at
        ok = (i < j) & ((group[i] != group[j]) | (group[i] < 0))
        i, j = i[ok], j[ok]
        here = keys[:, table]
        for t in range(table):  # met before?
            if not len(i):
                break
            seen = (keys[i, t][:, :, None] == keys[j, t][:, None, :]).any((1, 2))
            i, j = i[~seen], j[~seen]
        if len(i):
            same = here[i][:, :, None] == here[j][:, None, :]
            low = np.where(same, here[i][:, :, None], np.iinfo(np.int64).max).min((1, 2))
            i, j = i[low == key], j[low == key]
        total += np.bincount(i, weights=m[j], minlength=n).astype(np.int64) + np.bincount(j, weights=m[i], minlength=n).astype(np.int64)
        la.append(i)
        lb.append(j)
    i, j = np.concatenate(la), np.concatenate(lb)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (before == label).all():
            break
    return total, label


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, column: str = "embedding") -> DataFrame:
    """One row per row of `vectors`: (vec_id, n_links, component_id, kept). n_links counts the other vectors with
    a cosine of at least `threshold` that the tables find, equal vectors included; component_id is the smallest
    vec_id reachable. Null, empty, zero and non-finite vectors and those with null components link with nothing,
    nor do vectors of different lengths. Rows with a null vec_id link with nothing and have a null component_id and
    kept; rows that repeat a vec_id are vectors of their own. Other columns are not read."""
    small_batches(vectors.sparkSession, 2000)
    rows = write_table(_classes(vectors, column).withColumn("row", F.monotonically_increasing_id()), "vectors")
    good = rows.filter("key is not null and vec_id is not null")
    good = write_table(good.groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.min("row").alias("id"), F.count("*").alias("m"), F.first("vec").alias("vec")), "classes")
    n, size = good.agg(F.count("*"), F.coalesce(F.max(F.length("vec")) / 8, F.lit(2))).first()
    hashes, tables = settings(n, int(size), threshold)
    reps = write_table(_hashed(good.select("id", "m", "vec"), hashes, tables), "reps")
    light = reps.select(F.explode(F.array_distinct("keys")).alias("key"), "id")
    # Of buckets that hold the same vectors the first is enough: the first that any pair of them shares.
    met = light.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("x2")).filter("c > 1") \
        .groupBy("c", "x1", "x2").agg(F.min("key").alias("key")).select("key", "c")
    # Large buckets are split: rows are dealt to chunks, and each pair of chunks is compared in its own part.
    parts = F.ceil(F.col("c") / CHUNK).cast("int")
    dealt = light.join(met, "key").withColumn("parts", parts).withColumn("chunk", F.pmod(F.xxhash64("id"), parts).cast("int"))
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = dealt.select("key", "id", "chunk", "parts", F.explode(other).alias("o")).select(
        "key", "id", "chunk", (F.least("o", "chunk") * F.col("parts") + F.greatest("o", "chunk")).alias("part"), "parts")
    heavy = dealt.join(reps, "id").repartition("key", "part").sortWithinPartitions("key", "part")

    def run(batches):
        held: list = []

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            key, part, parts = (t.column(c).to_numpy() for c in ("key", "part", "parts"))
            edge = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, [len(key)]])
            ids, m, chunk = (t.column(c).to_numpy() for c in ("id", "m", "chunk"))
            vecs = t.column("vec").to_pylist()
            keys = np.array(t.column("keys").combine_chunks().flatten()).reshape(-1, tables, PROBES)
            got: list = [[], [], []]
            for i, j in zip(edge[:-1], edge[1:]):
                if j - i < 2 or len({len(v) for v in vecs[i:j]}) > 1:
                    continue
                x = np.frombuffer(b"".join(vecs[i:j]), np.float64).reshape(j - i, -1)
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                a, b = divmod(int(part[i]), int(parts[i]))
                total, label = _links(ids[i:j], m[i:j], x, keys[i:j], key[i], chunk[i:j] if a != b else np.full(j - i, -1), threshold)
                some = total > 0
                for col, v in zip(got, (ids[i:j][some], total[some], label[some])):
                    col.append(v)
            held.clear()
            if got[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in got], names=["id", "links", "low"])

        last = None
        for b in batches:
            if not len(b):
                continue
            key, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            differs = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            tail = int(differs[-1]) + 1 if len(differs) else 0
            if tail:
                held.append(b.slice(0, tail))
            if held and (tail or last != (key[0], part[0])):
                yield from out()
            held.append(b.slice(tail))
            last = (key[-1], part[-1])
        if held:
            yield from out()

    found = write_table(heavy.select("key", "part", "parts", "chunk", "id", "m", "vec", "keys").mapInArrow(run, "id long, links long, low long"), "links")
    comp = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = good.select("key", "id", "vec_id", "m").join(links, "id", "left").join(comp, "id", "left").withColumn("of", F.coalesce("component_id", "id"))
    least = of.groupBy("of").agg(F.min("vec_id").alias("component_id"))
    final = of.drop("component_id").join(least, "of").select("key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    return rows.select("vec_id", "key").join(final, "key", "left").select(
        "vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"), (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))
