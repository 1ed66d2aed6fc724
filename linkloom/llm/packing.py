"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Pieces are packed by best-fit decreasing in groups of bounded size. Dual feasible functions give each group a
lower bound on its bin count. A group that meets its bound is done; groups with a gap put the contents of
their unfilled bins together, exchange them by a new grouping, and are packed again. A round's exchange stands
only if it saves bins. At last the emptiest bins of all groups are exchanged, towards the bound of all pieces.
Only lengths travel between rounds, in written tables; only counts by length and load are collected."""

from __future__ import annotations

import os
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, ids_of_texts, small_batches, worker_state, write_table


#: A character that is a token of its own between blanks, and is hardly ever in a text.
BETWEEN = "\x01"

class WordIds:
    """Token ids of ASCII-white-space-separated words, as bytes of unsigned 32-bit little-endian numbers. Right
    for tokenizers that drop white space and whose patterns never cross it. Words are kept in two generations:
    when the young one is full it becomes the old one, from which a word that is met again comes back, so
    frequent words stay and words met once go."""

    def __init__(self, path: str, cache_entries: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.cache = WordCache({})
        self.most = cache_entries // 2
        between = self.tok.encode(BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None

    def learn(self, words: list[bytes], run: int = 64) -> list[bytes]:
        """The ids of words. Words are encoded in runs with BETWEEN between them, which is
        cheaper than one by one; a run with more of it than that is encoded word by word."""
        out: list[bytes] = []
        starts = range(0, len(words), run)
        for group in range(0, len(starts), 64):
            part = [words[i: i + run] for i in starts[group: group + 64]]
            for ws, e in zip(part, self.encode([f" {BETWEEN} ".join([w.decode() for w in ws]) for ws in part], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                cut = np.flatnonzero(ids == self.between) if self.between is not None else ids[:0]
                if len(cut) == len(ws) - 1 and not any(b"<|" in w for w in ws):
                    raw = ids.tobytes()
                    cut = (4 * cut).tolist()
                    out += [raw[i:j] for i, j in zip([0, *[c + 4 for c in cut]], [*cut, len(raw)])]
                else:
                    out += [np.array(x.ids, "<u4").tobytes() for x in self.encode([w.decode() for w in ws], add_special_tokens=False)]
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Letters A-Z are lowered first, as the tokenizer does, unless a special string may
        stand in the text."""
        if len(self.cache) > self.most:
            self.cache = WordCache(dict(self.cache))
        return ids_of_texts(texts, lambda t: (t if b"<|" in t else t.lower()).split(), self.cache, self.learn)


def pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int = 0, cache_entries: int = 500_000) -> DataFrame:
    """The pieces of each document's ids (a null text is empty) with `end_id` after them: (doc_id, piece, start,
    length, ids_crc32). Only documents longer than `size` are cut; repeated rows give pieces each."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        state = worker_state(f"ids {tokenizer_path}", lambda: WordIds(tokenizer_path, cache_entries))
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            texts = [t or b"" for t in b.column(1).to_pylist()]
            for d, ids in zip(b.column(0).to_pylist(), state.ids(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at: at + 4 * size]
                    for col, v in zip(out, (d, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and its offset there. Open bins are kept by free space, and a bit set of the
    spaces that occur finds the tightest fit in one step."""
    order = np.argsort(-lengths, kind="stable")
    bins, offs = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]
    bits = n = 0
    for i, w in zip(order.tolist(), lengths[order].tolist()):
        fit = bits >> w
        if fit:
            space = w + (fit & -fit).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                bits &= ~(1 << space)
        else:
            space, b, n = size, n, n + 1
        bins[i], offs[i] = b, size - space
        left = space - w
        if left:
            free[left].append(b)
            bits |= 1 << left
    return bins, offs


def bin_bound(lengths: np.ndarray, size: int) -> int:
    """A lower bound on the bins that pieces need, the best over two families of dual feasible functions: the
    threshold functions (long pieces count as a whole bin, short ones as nothing) and the rounding functions
    w -> floor((k+1) w / size) / k."""
    return count_bound(np.bincount(lengths, minlength=size + 1).astype(np.int64), size) if len(lengths) else 0


def count_bound(count: np.ndarray, size: int) -> int:
    """bin_bound of `count` pieces of each length from 0 to size."""
    w = np.arange(size + 1)
    total = int((count * w).sum())
    best = -(-total // size)
    from_top = np.cumsum(count[::-1])[::-1]
    mass = np.concatenate([[0], np.cumsum(count * w)])
    for e in range(1, size // 2 + 1):
        whole = int(from_top[size - e + 1])
        best = max(best, whole + -(-int(mass[size - e + 1] - mass[e]) // size))
    for k in range(1, 33):
        f = (k + 1) * w
        exact = f % size == 0
        value = np.where(exact, k * w, (f // size) * size)  # in units of 1 / (k * size)
        best = max(best, -(-int((count * value).sum()) // (k * size)))
    return best


def _pack_groups(rows: DataFrame, size: int, level: int) -> DataFrame:
    """Rows with `g` (the group) packed in their groups: sequence_id, offset, load (of the bin), gap (bins over
    the group's bound)."""

    def run(t: pa.Table) -> pa.Table:
        lengths = t.column("length").to_numpy()
        bins, offs = best_fit_decreasing(lengths, size)
        n = int(bins.max()) + 1
        load = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)[bins]
        same = lambda v: np.full(len(t), v, np.int64)
        new = {"sequence_id": (level << 58) + (t.column("g")[0].as_py() << 24) + bins, "offset": offs, "load": load, "gap": same(n - bin_bound(lengths, size)), "bins": same(n)}
        for name, v in new.items():
            t = t.append_column(name, pa.array(v))
        return t

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, g long, sequence_id long, offset long, load long, gap long, bins long"
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "row", "g").groupBy("g").applyInArrow(run, schema)


def _merge_lightest(parts: list[DataFrame], size: int, bound: int, level: int, group: int) -> tuple[list[DataFrame], int]:
    """Exchange the emptiest bins of all groups, about `group` pieces of them at once, as long as that saves bins
    and there are more than `bound`: the pieces, and the bins over the bound. The bins of one load are its tokens
    divided by it."""
    turn = 0
    while True:
        rows = reduce(DataFrame.unionByName, parts)
        loads = sorted(tuple(r) for r in rows.groupBy("load").agg(F.count("*"), F.sum("length")).collect())
        over = sum(tokens // load for load, _, tokens in loads) - bound
        if over <= 0:
            return parts, 0
        top = m = 0
        share = 1
        for load, n, _ in loads:
            if load >= size or m >= group:
                break
            top, share, m = load, max(1, -(-n // (group - m))), m + n
        mine = (F.col("load") < top) | (F.col("load") == top) & (F.pmod(F.xxhash64("sequence_id"), F.lit(share)) == 0)
        opened = rows.filter(mine).withColumn("g", F.lit(turn).cast("long"))
        was = opened.agg(F.countDistinct("sequence_id")).first()[0]
        if was < 2:
            return parts, over
        again = write_table(_pack_groups(opened, size, level), "packed")
        if again.first()["bins"] >= was:
            return parts, over
        parts = [p.filter(~mine) for p in parts] + [again]
        turn += 1


def pack(cut: DataFrame, size: int, group: int = 40_000, rounds: int = 12) -> DataFrame:
    """`cut` (as pieces() gives it) with sequence_id, offset and over_bound; any sequence holds at most `size` tokens
    without gaps. group bounds the pieces packed in one task; groups with a gap to their bound exchange pieces as long
    as a round saves sequences, `rounds` times at most. After that the emptiest bins of all groups are exchanged,
    towards the bound of all pieces; over_bound is how many sequences there are over that bound, 0 where no packing
    can have fewer. Whole pieces of `size` tokens are sequences as they are. Nulls in doc_id and repeated rows are
    packed like others and dealt to groups like others; an empty table gives an empty result."""
    cut = cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("row"))
    full = cut.filter(F.col("length") >= size).select("doc_id", "piece", "start", "length", "ids_crc32", (F.lit(1 << 62) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter(F.col("length") < size)
    done, level = [], 0
    count = np.zeros(size + 1, np.int64)
    for length, k in rest.groupBy("length").count().collect():
        count[length] = k
    n = int(count.sum())
    dealt = lambda groups: F.pmod(F.xxhash64("doc_id", "piece", "row", F.lit(level)), F.lit(groups))
    packed = write_table(_pack_groups(rest.withColumn("g", dealt(-(-n // group) or 1)), size, level), "packed")
    final = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for level in range(1, rounds + 1):
        open_ = (F.col("gap") > 0) & (F.col("load") < size)
        was, m = packed.filter(open_).agg(F.countDistinct("sequence_id"), F.count("*")).first()
        if was < 2 or packed.select("g").filter("gap > 0").distinct().count() < 2:
            break
        again = write_table(_pack_groups(packed.filter(open_).withColumn("g", dealt(-(-m // group))), size, level), "packed")
        if again.agg(F.countDistinct("sequence_id")).first()[0] >= was:
            break
        done.append(packed.filter(~open_))
        packed = again
    out = full.select(final)
    parts, over = _merge_lightest([packed, *done], size, count_bound(count, size), rounds + 1, group)
    for d in parts:
        out = out.unionByName(d.select(final))
    return out.withColumn("over_bound", F.lit(over).cast("long"))


def best_fit_pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, group: int = 40_000, rounds: int = 12) -> DataFrame:
    """Tokenise, cut and pack whole documents: (doc_id, piece, start, length, ids_crc32, sequence_id, offset,
    over_bound). Columns other than doc_id and text are not read."""
    return pack(write_table(pieces(docs, tokenizer_path, size, end_id), "pieces"), size, group, rounds)
