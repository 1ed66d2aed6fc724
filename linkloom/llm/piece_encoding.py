"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that workers have not met are concatenated into one text with a suffix array over it. Each
piece of the vocabulary is found by binary search as a range of suffixes: these are all places where it occurs.
The resulting edges are sorted by position and relaxed from left to right. For a BPE model the relaxation is by
compatibility: of the edges that end at a place, the one that follows the encoding of what is before it is the
one whose pair with its left neighbour the merges would leave apart. Characters that no piece has are edges of
their own and become bytes."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import WordCache, ids_of_texts, mix, small_batches, worker_state

SPACE = "▁"
#: No piece has a line feed, or a space mark after another character: none crosses the end of such a word.
WORD = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


LEARN = 100_000  # characters of new words that are encoded at a time, or one longer word
DEEP = 64  # characters up to which words are relaxed together, a place at a time; longer ones are relaxed alone
KNOWN = 1 << 20  # pairs of pieces whose compatibility is kept


def _fields(message: bytes):
    """The fields of a serialized protocol buffer: (number, value), numbers or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, message[at: at + n]
            at += n


def check_model(proto: bytes) -> None:
    """Raise ValueError unless the model is a BPE one that takes texts as they are, with the space mark before them
    and single bytes for what no piece has: others need another relaxation."""
    # Field numbers and defaults of the model file's format.
    top = dict(_fields(proto))
    trainer, normal = dict(_fields(top.get(2, b""))), dict(_fields(top.get(3, b"")))
    if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
        raise ValueError("not a BPE model with single bytes for unknown characters")
    if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1):
        raise ValueError("the model normalises texts, folds white space or has no space mark")


class Pieces:
    """The vocabulary of a model file and the merges it implies."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(sp.serialized_model_proto())
        n = sp.vocab_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte)}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        # The place of each piece's merge in the order of merges; single characters come before all.
        order = {v: k + 1 for k, v in enumerate(sorted({v for t, v in self.score.items() if len(t) > 1}, reverse=True))}
        self.place = {t: order[v] for t, v in self.score.items() if len(t) > 1}
        self.halves: dict[str, tuple[str, str] | None] = {}
        # Pieces laid out for the search.
        self.patterns = Patterns(sorted(self.ids))
        self.lengths = self.patterns.lengths
        self.longs, self.longest = self.lengths.tolist(), int(self.lengths.max())
        self.numbers = np.array([self.ids[t] for t in self.patterns.texts], "<i4")
        # Pairs of pieces whose compatibility is known: one for each value of a hash, the latest.
        self.known, self.apart = np.full(KNOWN, -1, np.int64), np.zeros(KNOWN, bool)

    def bytes_of(self, c: str) -> np.ndarray:
        """The ids of a character without a piece."""
        return np.array([self.byte[b] for b in c.encode("utf-8", "replace")], "<i4")

    def all_compatible(self, keys: np.ndarray) -> np.ndarray:
        """compatible() of each key, by the table of known ones."""
        slot = (mix(keys.view(np.uint64)) % np.uint64(KNOWN)).astype(np.int64)
        out = self.apart[slot]
        miss = np.flatnonzero(self.known[slot] != keys)
        if len(miss):
            new, at = np.unique(keys[miss], return_inverse=True)
            got = np.array([self.compatible(k) for k in new.tolist()], bool)
            out[miss] = got[at]
            self.known[slot[miss]], self.apart[slot[miss]] = keys[miss], out[miss]
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        """BPE merges: the best-scored neighbours whose union is a piece, leftmost first among equals; the last two
        symbols where only one would be left."""
        while len(symbols) > 2:
            best, where = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if best is None:
                break
            symbols[where: where + 2] = [symbols[where] + symbols[where + 1]]
        return symbols

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two symbols whose merge makes a piece of several characters; None if its merges don't make it."""
        if piece not in self.halves:
            got = self.merge(list(piece))
            self.halves[piece] = (got[0], got[1]) if len(got) == 2 else None
        return self.halves[piece]

    def compatible(self, key: int) -> bool:
        """Do the merges leave two pieces as they are when they stand side by side? Their own merges are taken
        back, the later one first; what then meets at the border must not have merged before it. The key holds
        both numbers; those past the pieces are single characters."""
        n, place = len(self.patterns.texts), self.place
        left, right = (self.patterns.texts[x] if x < n else chr(x - n) for x in (key >> 32, key & 0xFFFFFFFF))
        ok = all(len(t) == 1 or self.split(t) for t in (left, right))
        before = 1 << 60  # merges of places below this come first
        while ok:
            if place.get(left + right, before) < before:
                ok = False
                break
            a, b = place.get(left, 0), place.get(right, 0)
            if not a and not b:
                break
            # Of equal places the left one's merge is first, so the right one's is taken back first.
            if a > b:
                before, left = a, self.split(left)[1]
            else:
                before, right = b + 1, self.split(right)[0]
        return ok


def suffixes(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of an array of code points in order of their first `depth` ones at least (prefix doubling)."""
    n = len(codes)
    rank = codes.astype(np.int64)
    step = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[:-step or None] = rank[step:] + 1
        key = rank * (int(nxt.max()) + 1) + nxt
        order = np.argsort(key)  # equal keys in any order
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        step *= 2
        if step >= depth:
            return order


def packed(codes: np.ndarray) -> np.ndarray:
    """Three code points from each place on as one number; past the end they are 0."""
    c = np.concatenate([codes.astype(np.int64) + 1, np.zeros(2, np.int64)])
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


class Patterns:
    """Pieces laid out for the search: for each block of three characters, the range of packed numbers that it
    matches."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        n = -(-int(self.lengths.max()) // 3)
        self.low, self.high = np.zeros((n, len(texts)), np.int64), np.zeros((n, len(texts)), np.int64)
        for i, t in enumerate(texts):
            for j in range(0, len(t), 3):
                part = [ord(c) + 1 for c in t[j: j + 3]]
                shift = 21 * (3 - len(part))
                v = 0
                for c in part:
                    v = v << 21 | c
                self.low[j // 3, i], self.high[j // 3, i] = v << shift, (v + 1) << shift


def occurrences(codes: np.ndarray, order: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """All places of all patterns in the text: (place, pattern's number), by binary search in its suffix array
    of all patterns at once, a block of characters after the other."""
    at = packed(codes)
    head = at[order]
    lo, hi = np.searchsorted(head, patterns.low[0]), np.searchsorted(head, patterns.high[0])
    for j in range(1, len(patterns.low)):
        live = np.flatnonzero((patterns.lengths > 3 * j) & (lo < hi))
        if not len(live):
            break
        block = np.concatenate([at, np.zeros(3 * j, np.int64)])
        found = []
        for want in (patterns.low[j, live], patterns.high[j, live]):
            a, b = lo[live], hi[live]
            for _ in range(int(b.max() - a.min()).bit_length() + 1):
                mid = (a + b) >> 1
                open_ = a < b
                less = open_ & (block[order[np.minimum(mid, len(order) - 1)] + 3 * j] < want)
                a = np.where(less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            found.append(a)
        lo[live], hi[live] = found
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    return order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], which


class Encoder:
    """Encodes texts with a cache of words in two generations: when the young one is full it becomes the old one, from
    which a word that is met again comes back."""

    def __init__(self, path: str, cache_entries: int = 600_000):
        self.pieces, self.most = Pieces(path), cache_entries // 2
        self.cache = self._fresh({})

    def _fresh(self, before: dict) -> WordCache:
        out = WordCache(before)
        out["\n"] = self.pieces.bytes_of("\n").tobytes()  # no piece has it
        return out

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of words, of which none has a line feed, encoded about LEARN characters at a time, or one longer
        word."""
        out: list[bytes] = []
        while len(out) < len(words):
            i = j = len(out)
            size = 0
            while j < len(words) and (j == i or size + len(words[j]) < LEARN):
                size += len(words[j]) + 1
                j += 1
            out += self._learn(words[i:j])
        return out

    def _learn(self, words: list[str]) -> list[bytes]:
        p = self.pieces
        by_length = sorted(range(len(words)), key=lambda i: -len(words[i]))
        words = [words[i] for i in by_length]
        codes = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        at, which = occurrences(codes, suffixes(codes, p.longest), p.patterns)
        ends = at + p.patterns.lengths[which]
        by = np.argsort(ends * (p.longest + 1) - p.patterns.lengths[which])  # edges by the place where they end, longest first
        edges, bound = which[by], np.searchsorted(ends[by], np.arange(len(codes) + 1), "left")
        n = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(n + 1) - n - 1
        long = int((n > DEEP).sum())
        last = np.zeros(len(codes) + 1, np.int64)  # the last piece of the encoding up to each place
        for i in range(long):
            self._relax_word(codes, edges, bound, last, int(begin[i]), int(n[i]))
        self._relax_words(codes, edges, bound, last, begin[long:], n[long:])
        # Back from the words' ends, all words a piece at a time.
        left, live, steps = n.copy(), np.arange(len(words)), []
        while len(live):
            e = last[begin[live] + left[live]]
            steps.append((live, e))
            left[live] -= p.lengths[e] if int(e.max(initial=0)) < len(p.lengths) else np.where(e < len(p.lengths), p.lengths[np.minimum(e, len(p.lengths) - 1)], 1)
            live = live[left[live] > 0]
        owner, e = (np.concatenate([x[k] for x in steps]) for k in (0, 1))
        turn = np.repeat(np.arange(len(steps)), [len(x[0]) for x in steps])
        order = np.lexsort((-turn, owner))
        owner, e = owner[order], e[order]
        if int(e.max()) >= len(p.lengths):  # characters without a piece are bytes
            parts = [p.numbers[x: x + 1] if x < len(p.lengths) else p.bytes_of(chr(x - len(p.lengths))) for x in e.tolist()]
            owner = np.repeat(owner, [len(x) for x in parts])
            ids = np.concatenate(parts)
        else:
            ids = p.numbers[e]
        raw = ids.tobytes()
        cut = (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        out = [b""] * len(words)
        for k, i, j in zip(by_length, cut, cut[1:]):
            out[k] = raw[i:j]
        return out

    def _relax_word(self, codes, edges, bound, last, begin: int, n: int) -> None:
        """Relax the edges of one long word, place by place."""
        p = self.pieces
        size, bound = len(p.lengths), bound[begin: begin + n + 2].tolist()
        edges = edges[bound[0]: bound[-1]].tolist()
        shift = bound[0]
        got = [0] * (n + 1)
        for i in range(1, n + 1):
            got[i] = size + int(codes[begin + i - 1])
            for e in edges[bound[i] - shift: bound[i + 1] - shift]:
                j = i - p.longs[e]
                if not j or p.compatible(got[j] << 32 | e):
                    got[i] = e
                    break
        last[begin + 1: begin + n + 1] = got[1:]

    def _relax_words(self, codes, edges, bound, last, begin, n) -> None:
        """Relax the edges of words, longest first, all words one place at a time."""
        p = self.pieces
        alive = np.searchsorted(-n, -np.arange(int(n[0]) + 1 if len(n) else 0), "right")
        for i in range(1, len(alive)):
            at = begin[: alive[i]] + i
            best = codes[at - 1].astype(np.int64) + len(p.lengths)
            todo = np.arange(len(at))
            place, end = bound[at], bound[at + 1]
            while True:
                todo = todo[place[todo] < end[todo]]
                if not len(todo):
                    break
                e = edges[place[todo]]
                j = i - p.lengths[e]
                ok = j == 0
                inner = np.flatnonzero(j)
                ok[inner] = p.all_compatible(last[begin[todo[inner]] + j[inner]] << 32 | e[inner])
                best[todo[ok]] = e[ok]
                todo = todo[~ok]
                place[todo] += 1
            last[at] = best

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        if len(self.cache) > self.most:
            self.cache = self._fresh(dict(self.cache))
        return ids_of_texts(texts, lambda t: WORD.findall(SPACE + t.replace(" ", SPACE)) if t else (), self.cache, self.learn)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are joined into characters, control ids have no text, the space that encoding
        puts before a text goes."""
        p, out = self.pieces, bytearray()
        for i in ids:
            b = p.byte_of.get(i)
            if b is not None:
                out.append(b)
            elif i not in p.control:
                out += (" ⁇ " if i == p.unknown else p.text[i]).encode()
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _encoder(path: str) -> Encoder:
    return worker_state(f"pieces {path}", lambda: Encoder(path))


def encode(docs: DataFrame, model_path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """`docs` with the piece ids of each text as array<int>; a null or empty text has none. Other columns pass
    through, one called `name` is replaced; repeated rows are encoded each."""
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    at = docs.columns.index(text)

    def run(batches):
        e = _encoder(model_path)
        for b in batches:
            ids = [np.frombuffer(x, "<i4") for x in e.encode([t or "" for t in b.column(at).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(IntegerType()))]))


def decode(docs: DataFrame, model_path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """`docs` with the text of each array of ids; null gives ''."""
    from pyspark.sql.types import StringType

    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    at = docs.columns.index(ids)

    def run(batches):
        e = _encoder(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([e.decode(x or []) for x in b.column(at).to_pylist()], pa.string())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType())]))


def report(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_chars, n_ids, n_byte_ids, ids_crc32, round_trip) of each text: the numbers of code points, of
    ids, and of ids that stand for single bytes, the checksum of the ids as little-endian 32-bit numbers, and
    whether decoding gives the text back."""
    small_batches(docs.sparkSession)

    def run(batches):
        e = _encoder(model_path)
        p = e.pieces
        is_byte = np.zeros(len(p.text), bool)
        is_byte[p.byte] = True
        table = [t.replace(SPACE, " ").encode() for t in p.text]
        for i, b in p.byte_of.items():
            table[i] = bytes([b])
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            cols: list[list] = [[] for _ in range(5)]
            for t, x in zip(texts, e.encode(texts)):
                ids = np.frombuffer(x, "<i4")
                back = b"".join(map(table.__getitem__, ids.tolist()))
                for col, v in zip(cols, (len(t), len(ids), int(is_byte[ids].sum()), zlib.crc32(x), back == (b" " + t.encode() if t else b""))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64() if i < 4 else pa.bool_()) for i, c in enumerate(cols))], names=["doc_id", "n_chars", "n_ids", "n_byte_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean")
