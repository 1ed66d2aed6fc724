"""The prefix trie of conversations: each distinct sequence of first turns is a node, with what its subtree holds.

Turns get a number by hash, and texts that share one are told apart by themselves. Conversations lie in ranges of
(conversation, turn), so a conversation of any length is spread over tasks; what a range needs of the ones before it is
one row a range. A numpy scan gives each place the polynomial fingerprint of the prefix that ends there, over two
primes. Places of a depth and fingerprint are a group. A group is right if all its members have the same turn and the
same verified parent as its representative (the smallest conversation): by induction from the root all their turns are
then the same. That is a comparison of extremes that tasks combine before the shuffle. Groups that fail are split by
parent and turn, and so on down, until none fails.

Sums over subtrees take no walk by depth. A conversation is the smallest member of the nodes from some depth on down
to its end: those it owns, so every node is owned once. Bytes saved in a node's subtree are those that its members have
above the nodes they own, and leaves are owned ends: sums over a node's members of figures that each conversation has
once."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partition_count, small_batches, write_table

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525003)
BLOCK = 4096  # places of a conversation that meet its figures under one key
IDS = 4096  # conversation ids in one piece of a digest's input
NODE = ["depth", "fp", "split"]


# --- turns in order ---------------------------------------------------------------------------

def _turn_numbers(turns: DataFrame, bits: int) -> DataFrame:
    """`turn_hash` and `twin` of each row of (role, text), which together stand for exactly one role and text: texts of
    the same hash have different twins, from 0 on."""
    got = turns.withColumn("turn_hash", F.xxhash64("role", "text").bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1)))
    each = got.select("turn_hash", "role", "text").distinct()
    clash = each.groupBy("turn_hash").count().filter("count > 1").select("turn_hash")
    w = Window.partitionBy("turn_hash").orderBy("role", "text")
    twins = write_table(each.join(clash, "turn_hash", "left_semi").withColumn("twin", F.row_number().over(w) - 1), "twins")
    if twins.isEmpty():
        return got.withColumn("twin", F.lit(0))
    return got.join(twins, ["turn_hash", "role", "text"], "left").withColumn("twin", F.coalesce("twin", F.lit(0)))


def _in_ranges(df: DataFrame, *order) -> DataFrame:
    return df.repartitionByRange(partition_count(df.sparkSession), *order).sortWithinPartitions(*order)


def _segments(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal ids begin, and the run of each place."""
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _before(df: DataFrame, **sums: Column) -> DataFrame:
    """(conv_id, part, ...): for a conversation that began in earlier parts, the sums over these. That can only be the
    first conversation of a part, so there are fewer rows than parts."""
    each = df.groupBy("conv_id", "part").agg(*[c.alias(k) for k, c in sums.items()])
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("conv_id", "part", *[F.sum(k).over(w).alias(k) for k in sums], F.count("*").over(w).alias("_k")).filter("_k > 0").drop("_k")


def ordered_turns(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """(conv_id, idx, turn_hash, twin, n_bytes): every turn with its number in its conversation, from 0 on. Turns are
    in the order of `turn`, null first; those of the same number by role and a hash of the text; equal rows are turns
    of their own. Null roles and texts are empty; rows without a conv_id belong to no conversation."""
    spark = conversations.sparkSession
    small_batches(spark, 20_000)
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _turn_numbers(rows, bits)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "turn_hash", "twin", F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))

    def number(batches):
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(0).to_numpy()
            begin, of = _segments(conv)
            place = np.arange(len(conv)) - begin[of]
            if conv[0] == last:
                place[of == 0] += n
            last, n = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(conv), part)), pa.array(place), *b.columns[1:]], names=["conv_id", "part", "place", "turn_hash", "twin", "n_bytes"])

    # The row's own number ends the order, so that even one turn repeated over a third of all rows is spread.
    placed = _in_ranges(rows, "conv_id", F.col("turn").asc_nulls_first(), "role", "turn_hash", "twin", "row").select("conv_id", "turn_hash", "twin", "n_bytes")
    placed = write_table(placed.mapInArrow(number, "conv_id long, part long, place long, turn_hash long, twin int, n_bytes long"), "turns")
    before = _before(placed, earlier=F.count("*"))
    return placed.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("earlier", F.lit(0))).alias("idx"), "turn_hash", "twin", "n_bytes")


def _by_block(rows: DataFrame, place: str, figures: DataFrame, length: str) -> DataFrame:
    """Rows joined with their conversation's figures; of a long conversation every BLOCK places have a key of their
    own."""
    block = F.floor(F.col(place) / BLOCK).cast("long")
    spread = figures.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(length) / BLOCK).cast("long"))))
    return rows.withColumn("_block", block).join(spread, ["conv_id", "_block"]).drop("_block")


def graft(turns: DataFrame, every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: c begins with the first h turns of conversation c - c % every (fewer if it has fewer, none
    if there is none) and goes on with its own turns after its first h; h = crc32 of c's decimal form modulo
    most + 1. Turns (conv_id, depth from 1, turn_hash, twin, n_bytes, ends) and conversations (conv_id, length), also
    those without turns."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    plan = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1))
    plan = plan.join(convs.select(F.col("conv_id").alias("base"), F.col("own").alias("given")), "base", "left").withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
    plan = write_table(plan.select("conv_id", "base", "own", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "grafts")
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("idx") < most)).withColumnRenamed("conv_id", "base")
    front = heads.join(plan.select("conv_id", "base", "h", "length"), "base").filter("idx < h").withColumn("depth", F.col("idx") + 1)
    tail = _by_block(turns, "idx", plan.select("conv_id", "own", "h", "taken", "length"), "own").filter("idx >= h").withColumn("depth", F.expr("idx - h + taken + 1"))
    columns = ["conv_id", "depth", "turn_hash", "twin", "n_bytes", (F.col("depth") == F.col("length")).alias("ends")]
    return front.select(*columns).unionByName(tail.select(*columns)), plan.select("conv_id", "length")


def as_given(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, in the form that graft() gives."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    got = _by_block(turns, "idx", convs, "length")
    return got.select("conv_id", (F.col("idx") + 1).alias("depth"), "turn_hash", "twin", "n_bytes", (F.col("idx") + 1 == F.col("length")).alias("ends")), convs


# --- fingerprints -----------------------------------------------------------------------------

def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo a prime below 2 ** 31."""
    out, b, e = np.ones(len(exponents), np.uint64), np.uint64(base % prime), exponents.astype(np.uint64)
    p = np.uint64(prime)
    while e.any():
        out = np.where(e & np.uint64(1), out * b % p, out)
        b, e = b * b % p, e >> np.uint64(1)
    return out


def _prefixes(turns: DataFrame, primes: tuple[int, int]) -> DataFrame:
    """(conv_id, depth, fp, prev, turn_hash, twin, n_bytes, bytes, ends): the fingerprints of the prefix that ends at a
    turn and of the one before, and the bytes up to it."""
    def scan(batches):
        from pyspark import TaskContext

        part, last, carry = TaskContext.get().partitionId(), None, [0, 0, 0]
        for b in batches:
            if not b.num_rows:
                continue
            conv, depth = b.column("conv_id").to_numpy(), b.column("depth").to_numpy()
            begin, of = _segments(conv)
            value = b.column("turn_hash").to_numpy().view(np.uint64) + b.column("twin").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
            steps = [value % np.uint64(p) * powers(base, depth, p) % np.uint64(p) for base, p in zip(BASES, primes)] + [b.column("n_bytes").to_numpy().astype(np.uint64)]
            sums = []
            for k, (step, p) in enumerate(zip(steps, (*primes, None))):
                run = np.cumsum(step)
                run -= (run[begin] - step[begin])[of]
                if conv[0] == last:
                    run[of == 0] += np.uint64(carry[k])
                sums.append(run if p is None else run % np.uint64(p))
            last, carry = conv[-1], [int(s[-1]) for s in sums]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(np.full(len(conv), part)), b.column("depth"), *[pa.array(x.astype(np.int64)) for x in (*sums, *steps[:2])], *[b.column(c) for c in ("turn_hash", "twin", "n_bytes", "ends")]],
                                             names=["conv_id", "part", "depth", "s1", "s2", "bytes", "d1", "d2", "turn_hash", "twin", "n_bytes", "ends"])

    schema = "conv_id long, part long, depth long, s1 long, s2 long, bytes long, d1 long, d2 long, turn_hash long, twin int, n_bytes long, ends boolean"
    got = write_table(_in_ranges(turns, "conv_id", "depth").mapInArrow(scan, schema), "prefixes")
    before = _before(got, b1=F.sum("d1"), b2=F.sum("d2"), b3=F.sum("n_bytes"))
    got = got.join(F.broadcast(before), ["conv_id", "part"], "left").fillna(0, ["b1", "b2", "b3"])
    p, q = primes
    full = [F.expr(f"(s1 + b1 % {p}) % {p}"), F.expr(f"(s2 + b2 % {q}) % {q}")]
    prev = [F.expr(f"(s1 + b1 % {p} + {p} - d1) % {p}"), F.expr(f"(s2 + b2 % {q} + {q} - d2) % {q}")]
    pair = lambda x: F.shiftleft(x[0], 31) + x[1]
    return got.select("conv_id", "depth", pair(full).alias("fp"), pair(prev).alias("prev"), "turn_hash", "twin", "n_bytes", (F.col("bytes") + F.col("b3")).alias("bytes"), "ends")


def _groups(rows: DataFrame) -> DataFrame:
    """One row for each depth, fingerprint and split, with the extremes of its members' parents and turns."""
    same = ["prev", "prev_split", "turn_hash", "twin"]
    mixed = F.lit(False)
    for c in same:
        mixed = mixed | (F.min(c) != F.max(c))
    return rows.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.col("ends").cast("long")).alias("n_ends"), F.min("prev").alias("prev"), F.min("prev_split").alias("prev_split"),
                                   F.min("n_bytes").alias("n_bytes"), F.min("bytes").alias("bytes"), mixed.alias("mixed"))


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a column `split` that tells groups of one depth and fingerprint apart, and the groups, all verified.
    Depth by depth at least one round makes groups right, and groups that are right stay so."""
    rows = rows.withColumn("split", F.lit(0)).withColumn("prev_split", F.lit(0))
    while True:
        groups = write_table(_groups(rows), "nodes")
        wrong = groups.filter("mixed").select("depth", "fp").distinct()
        if wrong.isEmpty():
            return rows, groups.drop("mixed")
        step = ["depth", "fp", "prev", "prev_split", "turn_hash", "twin"]
        steps = rows.join(wrong, ["depth", "fp"], "left_semi").select(*step).distinct()
        steps = steps.withColumn("new", F.row_number().over(Window.partitionBy("depth", "fp").orderBy(*step[2:])) - 1)
        rows = rows.join(steps, step, "left").withColumn("new", F.coalesce("new", "split"))
        rows = write_table(rows.withColumn("moved", F.col("new") != F.col("split")).drop("split").withColumnRenamed("new", "split"), "split")
        moved = rows.filter("moved and not ends").select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("split").alias("_s"))
        rows = write_table(rows.drop("moved").join(moved, ["conv_id", "depth"], "left").withColumn("prev_split", F.coalesce("_s", "prev_split")).drop("_s"), "split")


# --- nodes ------------------------------------------------------------------------------------

def _end_digests(rows: DataFrame) -> DataFrame:
    """(depth, fp, split, ends_sha256) of nodes where conversations end: SHA-256 of their ids, ascending, joined by
    commas. Ids come in pieces that ranges have joined; a node's pieces stream through one hash, which can't be
    computed otherwise."""
    key = [*NODE, "conv_id"]

    def pieces(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(4)]
            new = np.zeros(b.num_rows, bool)
            new[::IDS] = True
            for c in cols[:3]:
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            ids = np.split(cols[3], at[1:])
            yield pa.RecordBatch.from_arrays([*[pa.array(c[at]) for c in cols[:3]], pa.array(np.full(len(at), part)), pa.array(n + np.arange(len(at))), pa.array([",".join(map(str, x.tolist())) for x in ids])],
                                             names=[*NODE, "part", "piece", "ids"])
            n += len(at)

    def digest(batches):
        key, h = None, None
        for b in batches:
            out: list = []
            for *k, ids in zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 5)]):
                if k == key:
                    h.update(b",")
                else:
                    if key is not None:
                        out.append((*key, h.hexdigest()))
                    key, h = k, sha256()
                h.update(ids.encode())
            yield rows_of(out)
        yield rows_of([(*key, h.hexdigest())] if key is not None else [])

    def rows_of(out):
        cols = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=[*NODE, "ends_sha256"])

    got = _in_ranges(rows.filter("ends").select(*key), *key).mapInArrow(pieces, "depth long, fp long, split int, part long, piece long, ids string")
    got = got.repartition(partition_count(rows.sparkSession), *NODE).sortWithinPartitions(*NODE, "part", "piece")
    return got.mapInArrow(digest, "depth long, fp long, split int, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """The nodes of the trie of conversations (turns and convs as graft() or as_given() give them), the root with
    depth 0 among them: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    Conversations without turns are members of the root; without conversations there are no nodes."""
    rows = _prefixes(turns, primes)
    root = convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "fp", "prev", "turn_hash")], F.lit(0).alias("twin"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("bytes"), (F.col("length") == 0).alias("ends"))
    rows, nodes = verified(rows.unionByName(root))
    # What each conversation adds to the nodes on its path: bytes above those it owns, and a leaf if its end is one.
    owned = nodes.groupBy("conv_id").agg(F.min(F.col("bytes") - F.col("n_bytes")).alias("above"), F.max((F.col("n_convs") == F.col("n_ends")).cast("long")).alias("leaf"))
    figures = rows.groupBy("conv_id").agg(F.max("bytes").alias("all"), F.max("depth").alias("last")).join(owned, "conv_id", "left")
    figures = figures.select("conv_id", "last", F.coalesce("above", "all").alias("above"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = _by_block(rows.select("conv_id", *NODE, (F.col("bytes") - F.col("n_bytes")).alias("upto")), "depth", figures, "last")
    sums = sums.groupBy(*NODE).agg(F.sum(F.greatest(F.col("above") - F.col("upto"), F.lit(0))).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    below = nodes.filter("depth > 0")
    kids = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("prev").alias("fp"), F.col("prev_split").alias("split")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("prev"), F.col("split").alias("prev_split"), F.col("conv_id").alias("parent_conv_id"))
    got = nodes.join(sums, NODE).join(kids, NODE, "left").join(_end_digests(rows), NODE, "left").join(parents, ["depth", "prev", "prev_split"], "left")
    return got.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
