"""Jaccard self-join on word n-grams with signature trees.

Every text becomes its set of shingle hashes. Texts of equal sets are one class from the start. Classes are
blocked by prefix: under one order of all shingles (frequent ones last, else by hash) two sets that are alike
enough share one of their first |x| - ceil(t |x|) + 1 shingles, so no link is lost. A pair need only be found in
the block of the first shingle that both have: there the places of that shingle in both bound their overlap, and
of blocks with the same classes one is enough, the first. Links are found in two rounds. First every class is
compared with one centre of each of its blocks, which joins groups of near copies without their pairs. Then, in
blocks that still hold several components, a signature tree finds what is left: its nodes hold OR- and
AND-combined bitmaps of their sets and ranges of sizes, and a traversal of pairs of nodes prunes those whose
largest possible overlap is too small, or that are in one component already. Pairs never leave a task: a block
gives the groups of its classes that the surviving pairs connect, and a second task compares a group's whole
sets and gives links that span it, fewer than it has classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, empty_worker, mix, shingle_sets, small_batches, write_table

BINS = 512  # in a class's signature; a tree's nodes have a bit for each
COARSE = 64  # bins of the signature that tells texts apart which merely share a passage
LEAF = 16
FANOUT = 8
FREQUENT = 1 << 17
BLOCK_ROWS = 512
STARS = 6  # rounds of further centres in blocks with more than BLOCK_ROWS classes outside their largest component
#: Ids up to this number are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles met in at least three texts of some 2 MB stretch, the FREQUENT ones with most such texts: hashes
    in ascending order of frequency. It shapes the order of shingles and so the work, never the result."""
    def run(batches):
        empty_worker()
        held: list[np.ndarray] = []
        size = 0

        def out():
            x, n = np.unique(np.concatenate(held), return_counts=True)
            x, n = x[n > 2], n[n > 2]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for b in batches:
            for s in shingle_sets(b.column(0), words):
                held.append(s)
                size += len(s)
            if size > 300_000:
                yield from out()
                size = 0
        if held:
            yield from out()

    got = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")) \
        .orderBy(F.col("n").desc(), "h").limit(FREQUENT).toArrow()
    return got.column("h").to_numpy().view(np.uint64)[::-1].copy()


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """How many shingles of a set fall into each bin (255 and more are one)."""
    return np.minimum(np.bincount((hashes >> np.uint64(20)).astype(np.int64) % bins, minlength=bins), 255).astype(np.uint8)


def prefix(hashes: np.ndarray, known: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles under the common order, as many as a linked set must share one of."""
    n = len(hashes)
    take = n - -(-percent * n // 100) + 1
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        often = known[at] == hashes
        plain = hashes[~often]
        if len(plain) < take:
            late = hashes[often][np.argsort(rank[at[often]], kind="stable")]
            return np.concatenate([plain, late[: take - len(plain)]])
        hashes = plain
    return hashes[:take]


def _set_key(s: np.ndarray) -> tuple[int, int, int]:
    """The size of a set and a 128-bit digest of it, as numbers with a sign."""
    return (len(s), int(np.bitwise_xor.reduce(s)) - (1 << 63), int(mix(s).sum(dtype=np.uint64)) - (1 << 63)) if len(s) else (0, 0, 0)


def classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Texts (doc_id, text) to (doc_id, n, k1, k2, prefix, signature, coarse): size and a 128-bit digest of each set,
    and for sets that can be like a different one, their prefix and signatures."""
    often = frequent_shingles(docs, words)
    order = np.argsort(often)
    shared = docs.sparkSession.sparkContext.broadcast((often[order], order))

    def run(batches):
        empty_worker()
        known, rank = shared.value
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for s in shingle_sets(b.column(1), words):
                n, k1, k2 = _set_key(s)
                alone = 100 * n < percent * (n + 1)
                more = (None, None, None) if alone else (prefix(s, known, rank, percent).view(np.int64), signature(s).tobytes(), signature(s, COARSE).tobytes())
                for col, v in zip(cols, (n, k1, k2, *more)):
                    col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n", "k1", "k2", "prefix", "signature", "coarse"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, prefix array<bigint>, signature binary, coarse binary")


# --- the signature tree -----------------------------------------------------------------------

def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def _bitmaps(signatures: np.ndarray) -> np.ndarray:
    """Which bins are met, as 64-bit words."""
    return np.packbits(signatures > 0, axis=1, bitorder="little").view(np.uint64)


def _allowed(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Do sizes and signatures allow two sets to be linked? What a bin has more in one signature than in the other
    are shingles that only one set has."""
    most = (n + m - (np.maximum(x, y) - np.minimum(x, y)).sum(1, dtype=np.int64)) // 2
    return (most * (100 + percent) >= percent * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _matrix(column) -> np.ndarray:
    """The signatures of a column, which has one at least."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


class Tree:
    """A tree over rows sorted by size and signature. levels[0] are the leaves' parents: for each level the
    nodes' OR and AND bitmaps, smallest and largest size, and component (or -1 where there are several). tail is
    the number of shingles from the block's own on, in the common order."""

    def __init__(self, n: np.ndarray, signatures: np.ndarray, bits: np.ndarray, comp: np.ndarray, tail: np.ndarray):
        self.n, self.signatures, self.comp, self.tail = n, signatures, comp, tail
        self.bits, self.levels = bits, []
        cur = (bits, bits, n, n, comp, tail)
        step = LEAF
        while True:
            starts = np.arange(0, len(cur[2]), step)
            low, high = np.minimum.reduceat(cur[4], starts), np.maximum.reduceat(cur[4], starts)
            cur = (np.bitwise_or.reduceat(cur[0], starts), np.bitwise_and.reduceat(cur[1], starts), np.minimum.reduceat(cur[2], starts),
                   np.maximum.reduceat(cur[3], starts), np.where(low == high, low, -1), np.maximum.reduceat(cur[5], starts))
            self.levels.append(cur)
            if len(starts) == 1:
                break
            step = FANOUT

    def candidates(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows, of different components, that the bounds allow to be linked."""
        left, right = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            o, a, lo, hi, c, t = self.levels[depth]
            same = (c[left] >= 0) & (c[left] == c[right])
            small, large = np.minimum(hi[left], hi[right]), np.maximum(lo[left], lo[right])
            fits = 100 * small >= percent * large
            most = np.minimum(hi[left] - _popcount(a[left] & ~o[right]), hi[right] - _popcount(a[right] & ~o[left]))
            most = np.minimum(most, np.minimum(t[left], t[right]))
            need = percent * (lo[left] + lo[right])  # overlap * (100 + percent) >= percent * (|x| + |y|)
            keep = ~same & fits & (most * (100 + percent) >= need)
            left, right = left[keep], right[keep]
            step, n = (FANOUT, len(self.levels[depth - 1][2])) if depth else (LEAF, len(self.n))
            i, j = np.divmod(np.arange(step * step), step)
            l, r = (left[:, None] * step + i).ravel(), (right[:, None] * step + j).ravel()
            ok = (l < n) & (r < n) & (l <= r)
            left, right = l[ok], r[ok]
        ok = (left < right) & (self.comp[left] != self.comp[right])
        ok &= np.minimum(self.tail[left], self.tail[right]) * (100 + percent) >= percent * (self.n[left] + self.n[right])
        left, right = left[ok], right[ok]
        out_l, out_r = [left[:0]], [left[:0]]
        for at in range(0, len(left), 10_000):
            x, y = left[at: at + 10_000], right[at: at + 10_000]
            n = self.n[x] + self.n[y]
            good = (n - _popcount(self.bits[x] ^ self.bits[y])) // 2 * (100 + percent) >= percent * n
            x, y = x[good], y[good]
            good = _allowed(self.n[x], self.n[y], self.signatures[x], self.signatures[y], percent)
            out_l.append(x[good])
            out_r.append(y[good])
        return np.concatenate(out_l), np.concatenate(out_r)


def tree_pairs(n: np.ndarray, signatures: np.ndarray, comp: np.ndarray, percent: int, tail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (row numbers) among the rows of one block."""
    bits = _bitmaps(signatures)
    order = np.lexsort((bits[:, -1], bits[:, 0], n))
    x, y = Tree(n[order], signatures[order], bits[order], comp[order], (n if tail is None else tail)[order]).candidates(percent)
    return order[x], order[y]


def connected(m: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of m rows: the smallest row number that each reaches over the pairs (x, y)."""
    label = np.arange(m)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def spanning_links(sets: list[np.ndarray], comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (row numbers) between rows of different components, only such as join what earlier ones don't:
    fewer than there are rows. Each row is compared in full with all that are not yet joined to it."""
    n = np.array([len(s) for s in sets], np.int64)
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.zeros(len(values), bool)
    label = np.unique(comp, return_inverse=True)[1]
    out = []
    for i in range(len(sets)):
        near = (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        near[:i] = False
        if not near.any():
            continue
        own = inverse[at[i]: at[i] + n[i]]
        mine[own] = True
        both = np.add.reduceat(mine[inverse], at, dtype=np.int64)
        mine[own] = False
        for j in np.flatnonzero(near & (100 * both >= percent * (n + n[i] - both))).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def _whole_groups(batches, n_keys: int):
    """Tables of whole groups, of batches sorted by their first `n_keys` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        differs = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols]))
        tail = int(differs[-1]) + 1 if len(differs) else 0
        if tail:
            held.append(b.slice(0, tail))
        if held and (tail or last != tuple(c[0] for c in cols)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(b.slice(tail))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _edges_of(t: pa.Table, n_keys: int) -> np.ndarray:
    """Where the groups of a sorted table begin, and its end."""
    cols = [t.column(k).to_numpy() for k in range(n_keys)]
    return np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1, [len(t)]])


def _pairs_within(edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one group each, of groups that begin at `edge` (the last is the end)."""
    size = np.diff(edge)
    later = np.repeat(edge[1:], size) - np.arange(edge[-1]) - 1
    x = np.repeat(np.arange(edge[-1]), later)
    return x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)


def _bounded(x: np.ndarray, y: np.ndarray, n: np.ndarray, comp: np.ndarray, tail: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows, of different components, that sizes and the places of the shared shingle allow."""
    ok = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
    ok &= np.minimum(tail[x], tail[y]) * (100 + percent) >= percent * (n[x] + n[y])
    return x[ok], y[ok]


def _candidate_groups(rows: DataFrame, by: list[str], percent: int) -> DataFrame:
    """(g, id, comp, n, tail): the groups of classes that candidate pairs connect within the blocks `by` of rows (by..,
    id, comp, n, tail and maybe signature). Without signatures sizes and tails tell candidates; with them, a
    signature tree, or one leaf of it in a small block. Of groups of the same classes that of the first shingle stays."""
    signed = "signature" in rows.columns

    def run(batches):
        empty_worker()
        for t in _whole_groups(batches, len(by)):
            edge = _edges_of(t, len(by))
            ids, comp, n, tail = (t.column(c).to_numpy() for c in ("id", "comp", "n", "tail"))
            x, y = np.zeros((2, 0), np.int64)
            if signed:
                signatures = _matrix(t.column("signature"))
            if signed and (np.diff(edge) > LEAF).any():
                for i, j in zip(edge[:-1], edge[1:]):
                    p, q = tree_pairs(n[i:j], signatures[i:j], comp[i:j], percent, tail[i:j])
                    x, y = np.concatenate([x, p + i]), np.concatenate([y, q + i])
            else:
                x, y = _bounded(*_pairs_within(edge), n, comp, tail, percent)
                if signed:
                    ok = _allowed(n[x], n[y], signatures[x], signatures[y], percent)
                    x, y = x[ok], y[ok]
            if not len(x):
                continue
            label = connected(len(t), x, y)
            met = np.unique(np.concatenate([x, y]))
            # A group's number: of its block and its first class.
            g = ids[label[met]].view(np.uint64)
            for k in by:
                g = mix(g) ^ t.column(k).to_numpy()[met].view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (mix(g).view(np.int64), ids[met], comp[met], n[met], tail[met])], names=["g", "id", "comp", "n", "tail"])

    cols = [*by, "id", "comp", "n", "tail", *(["signature"] if signed else [])]
    rows = rows.select(cols).repartition(*by).sortWithinPartitions(*by)
    got = write_table(rows.mapInArrow(run, "g long, id long, comp long, n long, tail long"), "groups")
    one = got.groupBy("g").agg(*_digest("id"), F.sum("tail").alias("tails")).groupBy("c", "x1", "x2").agg(F.max_by("g", F.struct("tails", "g")).alias("g")).select("g")
    return write_table(got.join(one, "g", "left_semi"), "groups")


def _digest(col: str) -> list:
    """The number of ids of a group and a digest of which they are."""
    return [F.count("*").alias("c"), F.bit_xor(F.xxhash64(col)).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), col)).alias("x2")]


def _joined_groups(groups: DataFrame) -> DataFrame:
    """Groups (g, id, comp) that share classes as one, where that has at most BLOCK_ROWS: a class's set then travels
    once and not with each group."""
    low = groups.groupBy("g").agg(F.min("id").alias("a"))
    whole = components(groups.join(low, "g").select("a", F.col("id").alias("b")))
    size = whole.groupBy("component_id").agg(F.count("*").alias("k")).filter(F.col("k") <= BLOCK_ROWS).select("component_id")
    to = whole.join(size, "component_id").select("id", F.col("component_id").alias("to"))
    return groups.join(to, "id", "left").select(F.coalesce(F.col("to"), F.col("g")).alias("g"), "id", "comp").distinct()


def _group_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span what the groups (g, id, comp) hold, by whole sets. A task has the sets of one group
    at a time, of at most about BLOCK_ROWS classes."""
    def run(batches):
        empty_worker()
        for t in _whole_groups(batches, 1):
            edge = _edges_of(t, 1)
            ids, comp = (t.column(c).to_numpy() for c in ("id", "comp"))
            lists = t.column("set").combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            out = []
            for i, j in zip(edge[:-1], edge[1:]):
                if j - i > 1:
                    out += [(ids[i + a], ids[i + b]) for a, b in spanning_links([flat[at[k]: at[k + 1]] for k in range(i, j)], comp[i:j], percent)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = groups.join(sets.select("id", "set"), "id").select("g", "id", "comp", "set")
    return write_table(rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long").distinct(), "links")


def _of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose `id` is among ids: by a broadcast where those are few, else by a shuffle."""
    ids = write_table(ids.distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and signatures allow to be linked. A row's prefix stays behind."""
    light = _of_ids(reps.select("id", "n", "signature"), pairs.select(F.explode(F.array("a", "b")).alias("id")))
    got = pairs.join(light.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("signature").alias("x")), "a") \
        .join(light.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("y")), "b")

    def run(batches):
        empty_worker()
        for b in batches:
            if not len(b):
                continue
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            x, y = _matrix(b.column(4)), _matrix(b.column(5))
            good = _allowed(na, nb, x, y, percent)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good))], names=["a", "b"])

    return got.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def _sets(ids: DataFrame, reps: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, set): the sets of the classes `ids` (id), made again from a text of each."""
    want = write_table(reps.select("id", "doc", "k1", "k2", "n").join(ids.distinct(), "id", "left_semi"), "wanted")
    few = F.broadcast if want.count() <= BROADCAST_IDS else lambda df: df
    doc = few(want.select("doc").distinct())

    def run(batches):
        empty_worker()
        for b in batches:
            sets = list(shingle_sets(b.column(0), words))
            key = [_set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in key], pa.int64()) for i in range(3)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["n", "k1", "k2", "set"])

    texts = docs.join(doc, docs["doc_id"] == doc["doc"], "left_semi").select("text")
    # An id may stand for several texts: the set's own key tells which class it is.
    got = texts.mapInArrow(run, "n long, k1 long, k2 long, set array<bigint>").join(few(want.select("id", "n", "k1", "k2")), ["n", "k1", "k2"])
    return write_table(got.dropDuplicates(["id"]).select("id", "set"), "sets")


def _pair_groups(pairs: DataFrame) -> DataFrame:
    """(g, id, comp) with every pair (a, b) in a group: the partners b of one a, in parts of about BLOCK_ROWS, with it in
    each. comp is the class itself."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    key = F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts")))
    rows = pairs.join(parts, "a").select(key.alias("g"), F.explode(F.array("a", "b")).alias("id")).distinct()
    return write_table(rows.withColumn("comp", F.col("id")), "groups")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links that span what the pairs (a, b) link whose sets are alike enough, compared in full."""
    groups = _pair_groups(write_table(_possible(write_table(pairs, "near"), reps, percent), "pairs"))
    return _group_links(groups, _sets(groups.select("id"), reps, docs, words), percent)


def _blocks(reps: DataFrame, percent: int) -> DataFrame:
    """(key, id, n, tail): the classes that have a shingle in their prefixes. tail counts a class's shingles from the
    key on. A block stays if it can be the first that a linked pair shares: the smaller set of such a pair has at
    least 2t / (1 + t) of its shingles from there on. Of blocks of the same classes the one of the first key stays,
    where the classes' tails are longest. Blocks of up to BLOCK_ROWS classes are then taken apart into groups that
    sizes and tails connect, each with a key of its own."""
    rows = reps.filter("prefix is not null").select("id", "n", F.posexplode("prefix").alias("pos", "key")).select("key", "id", "n", (F.col("n") - F.col("pos")).alias("tail"))
    first = (F.col("tail") * (100 + percent) >= 2 * percent * F.col("n"))
    per = rows.groupBy("key").agg(*_digest("id"), F.max(first).alias("first"), F.sum("tail").alias("tails")).filter("c > 1 and first")
    one = per.groupBy("c", "x1", "x2").agg(F.max_by("key", F.struct("tails", "key")).alias("key")).select("key", "c")
    rows = write_table(rows.join(one, "key"), "blocks")
    small = _candidate_groups(rows.filter(F.col("c") <= BLOCK_ROWS).withColumn("comp", F.col("id")), ["key"], percent)
    return small.select(F.col("g").alias("key"), "id", "n", "tail").unionByName(rows.filter(F.col("c") > BLOCK_ROWS).drop("c"))


def _several(keys: DataFrame, comp: DataFrame) -> DataFrame:
    """keys with `comp`, each class's component, of the blocks that hold several; with c (the block's classes), most
    (those of its largest component) and main (that component)."""
    keys = keys.join(comp.select("id", "component_id"), "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id")
    per = keys.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(
        F.sum("k").alias("c"), F.max("k").alias("most"), F.max_by("comp", F.struct("k", F.col("comp"))).alias("main"), F.count("*").alias("n_comps")).filter("n_comps > 1").drop("n_comps")
    return keys.join(per, "key")


def _band(percent: int, shift: float = 0.0):
    """The band of a size: sizes that allow a link are in one band or in neighbouring ones."""
    width = 1.001 * max(float(np.log(100 / percent)), 1e-6)
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(width) + F.lit(shift)).cast("long")


def _stars(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of the centre of each block and band of sizes with each other class there, of different components.
    The first centre is the class with the longest tail for its size, the one with least text of its own; later ones
    go by hash, in bands that begin elsewhere."""
    rows = rows.withColumn("band", _band(percent, turn * 0.5))
    order = F.struct((-F.col("tail") / F.col("n")).alias("o"), "id") if not turn else F.struct(F.xxhash64(F.lit(turn), "id").alias("o"), "id")
    centre = rows.groupBy("key", "band").agg(F.min_by(F.struct("id", "comp", "n", "tail"), order).alias("c"))
    centre = centre.select("key", "band", F.col("c.id").alias("centre"), F.col("c.comp").alias("other"), F.col("c.n").alias("m"), F.col("c.tail").alias("rest"))
    near = (F.least("tail", "rest") * (100 + percent) >= percent * (F.col("n") + F.col("m"))) & (F.least("n", "m") * 100 >= percent * F.greatest("n", "m"))
    return rows.join(centre, ["key", "band"]).filter((F.col("comp") != F.col("other")) & near).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()


def _parts(rows: DataFrame, percent: int) -> DataFrame:
    """Blocks in parts of about BLOCK_ROWS classes such that every pair of classes of different components whose sizes
    allow a link meets in one: rows (of _several) with `part`. A larger block's main component is dealt out, and
    its other classes, where they are at most BLOCK_ROWS, go to every part: at most as many copies again. Only what
    _stars leaves of blocks with more others is dealt by pairs of chunks, within bands of sizes."""
    parts = F.ceil(F.col("c") / BLOCK_ROWS).cast("int")
    few = (F.col("c") - F.col("most")) <= BLOCK_ROWS
    chunk = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("chunk", chunk)
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    band = _band(percent)
    of_pair = F.transform(every, lambda j: F.least(j, F.col("chunk")) * F.col("parts") + F.greatest(j, F.col("chunk")))
    # A band meets itself and the next: each class goes to its own band's parts and to those of the band below.
    banded = F.flatten(F.transform(F.array(band, band - 1), lambda s: F.transform(of_pair, lambda p: p.cast("long") + F.lit(1 << 40) * (s + 2))))
    simple = F.when(F.col("parts") == 1, F.array(F.lit(0))).when(F.col("comp") == F.col("main"), F.array("chunk")).otherwise(every)
    where = F.when((F.col("parts") == 1) | few, F.transform(simple, lambda p: p.cast("long"))).otherwise(banded)
    return rows.select("key", "id", "comp", "n", "tail", F.explode(where).alias("part"))


def similarity_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of `docs`: (doc_id, n_shingles, component_id), the smallest doc_id reachable by links
    of Jaccard likeness of at least `percent` hundredths between sets of `words`-word shingles. A text with
    fewer words is one shingle, a null or empty text has none and is its own component, as is a row with a null
    doc_id. Rows that repeat an id are answered each by its own text; an empty table gives an empty result. Other
    columns are not read."""
    small_batches(docs.sparkSession, 250)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = write_table(classes(docs, words, percent).withColumn("row", F.monotonically_increasing_id()), "classes")
    named = sets.filter("doc_id is not null and n > 0")
    reps = write_table(named.groupBy("k1", "k2", "n").agg(F.min("row").alias("id"), F.min("doc_id").alias("doc"), F.first("prefix").alias("prefix"), F.first("signature").alias("signature"), F.first("coarse").alias("coarse")), "reps")
    keys = _blocks(reps, percent)
    links = verified(_stars(keys.withColumn("comp", F.col("id")), percent, 0), reps, docs, words, percent)
    comp = components(links)
    rows = write_table(_several(keys, comp), "several")
    for turn in range(1, STARS):
        wide = rows.filter(F.col("c") - F.col("most") > BLOCK_ROWS)
        if wide.isEmpty():
            break
        more = verified(_stars(wide, percent, turn), reps, docs, words, percent)
        if more.isEmpty():
            break
        links = links.union(more)
        comp = components(links)
        rows = write_table(_several(keys, comp), "several")
    groups = _candidate_groups(_parts(rows, percent).join(reps.select("id", F.col("coarse").alias("signature")), "id"), ["key", "part"], percent)
    groups = _candidate_groups(groups.join(_of_ids(reps.select("id", "signature"), groups.select("id")), "id"), ["g"], percent)
    groups = write_table(_joined_groups(groups), "groups")
    more = _group_links(groups, _sets(groups.select("id"), reps, docs, words), percent)
    comp = components(links.union(more)) if not more.isEmpty() else comp
    of_class = reps.select("k1", "k2", "n", "id", "doc").join(comp, "id", "left").withColumn("of", F.coalesce("component_id", "id"))
    least = of_class.groupBy("of").agg(F.min("doc").alias("c"))
    final = of_class.select("k1", "k2", "n", "of").join(least, "of").select("k1", "k2", "n", "c")
    return sets.select("doc_id", "n", "k1", "k2").join(final, ["k1", "k2", "n"], "left") \
        .select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id")).alias("component_id"))
