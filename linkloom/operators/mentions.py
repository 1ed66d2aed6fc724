"""L1: mentions of a text, their contexts, and the steps over them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MENTIONS, keep_first, strip
from ..session import BATCH_ROWS, pieces

_word_table: list[np.ndarray] = []


def context_columns(df: DataFrame, left: int = 50, right: int = 50, text: str = "full_text") -> DataFrame:
    """left_context and right_context of the span (start, end) in the text, without white space at their ends."""
    t, s, e = F.col(text), F.col("start"), F.col("end")
    before = F.substring(t, F.greatest(s - left, F.lit(0)) + 1, F.least(s, F.lit(left)))
    return df.withColumn("left_context", strip(before)).withColumn("right_context", strip(F.substring(t, e + 1, F.lit(right))))


def extract(texts: DataFrame, find: Callable[[str], Iterator[tuple[int, int, str | None]]], left: int = 50, right: int = 50) -> DataFrame:
    """Mentions by a function text -> (start, end, label): a table function run in Arrow batches without any
    shuffle. It is the way in for patterns and for models, which load once per worker."""
    def run(batches):
        found = ((i, k, t, *x) for b in pieces(batches) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, x in enumerate(find(t or "")))
        yield from mention_batches(found, left, right)

    return texts.select("text_idx", "text").mapInArrow(run, MENTIONS)


def mention_batches(found: Iterable[tuple[int, int, str, int, int, str | None]], left: int, right: int, most: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Mentions of (text_idx, mention_idx, text, start, end, label), at most so many rows a batch: only those of one
    batch are held."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
    for part in batched(found, most):
        rows = zip(*((i, k, t[s:e], label, s, e, t[max(0, s - left): s].strip(), t[e: e + right].strip()) for i, k, t, s, e, label in part))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=MENTIONS.names)


def _is_word() -> np.ndarray:
    """Of each code point: is it a letter or a digit?"""
    if not _word_table:
        table = np.zeros(0x110000, bool)
        for m in regex.finditer(r"[\p{L}\p{N}]+", "".join(map(chr, range(0xD800))) + "\x00" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))):
            table[m.start(): m.end()] = True
        _word_table.append(table)
    return _word_table[0]


def _token_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Every run of letters and digits and every run of others in a column of texts: each token's row, its number in
    the text (from 1 on), where it starts there (in code points), and its text. No token is touched one by one:
    code points get a class from a table, and tokens are slices of the column's own bytes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    begins = ends - np.diff(np.concatenate([[0], ends]))
    word = _is_word()[points]
    cut = np.concatenate([[True], word[1:] != word[:-1]]) if len(points) else np.zeros(0, bool)
    cut[begins[begins < ends]] = True
    at = np.flatnonzero(cut)
    row = np.searchsorted(ends, at, "right")
    first = np.searchsorted(at, begins)  # of each row: the number of tokens before it
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    offsets = np.concatenate([[0], np.cumsum(width)])[np.concatenate([at, [len(points)]])]
    data = "".join(texts.to_pylist()).encode()
    tokens = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data))
    return row, np.arange(len(at)) - first[row] + 1, at - begins[row], tokens


def tokens(texts: DataFrame) -> DataFrame:
    """Every run of letters and digits and every run of others: (text_idx, pos, token, start)."""
    def run(batches):
        for b in pieces(batches):
            row, pos, start, token = _token_arrays(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(pos), token.cast(pa.string()), pa.array(start)], names=["text_idx", "pos", "token", "start"])

    return texts.select(F.col("text_idx").cast("long"), "text").mapInArrow(run, "text_idx long, pos long, token string, start long")


def _matching(tokens: pa.Array, pattern: str) -> np.ndarray:
    """Which tokens match a pattern as a whole: by Arrow's engine, or one by one if it doesn't know the pattern."""
    try:
        return pc.match_substring_regex(tokens, rf"\A(?:{pattern})\z").to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:
        whole = regex.compile(pattern)
        return np.array([whole.fullmatch(t) is not None for t in tokens.to_pylist()], bool)


def pattern_mentions(texts: DataFrame, pattern: str = r"\p{Lu}\p{L}{3,}", label: str | None = None, left: int = 50, right: int = 50) -> DataFrame:
    """Tokens that match the pattern as a whole, with their contexts, without any shuffle."""
    def run(batches):
        for b in pieces(batches):
            row, _, start, token = _token_arrays(b.column(1))
            hit = np.flatnonzero(_matching(token, pattern))
            row, start, token = row[hit], start[hit], token.take(pa.array(hit))
            end = start + pc.utf8_length(token).to_numpy(zero_copy_only=False).astype(np.int64)
            number = np.arange(len(row)) - np.searchsorted(row, row)
            texts = b.column(1).to_pylist()
            before, after = [], []
            for i, s, e in zip(row.tolist(), start.tolist(), end.tolist()):
                t = texts[i]
                before.append(t[max(0, s - left): s].strip())
                after.append(t[e: e + right].strip())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(number), token.cast(pa.string()), pa.array([label] * len(row), pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
                                              pa.array(before, pa.string()), pa.array(after, pa.string())], names=MENTIONS.names)

    return texts.select(F.col("text_idx").cast("long"), "text").mapInArrow(run, MENTIONS)


def external_mentions(df: DataFrame) -> DataFrame:
    """Given mentions brought to the common columns: text, start and end must be there."""
    missing = [c for c in ("text_idx", "text", "start", "end") if c not in df.columns]
    if missing:
        raise ValueError(f"mentions need {missing}")
    if "mention_idx" not in df.columns:
        df = df.withColumn("mention_idx", (F.row_number().over(Window.partitionBy("text_idx").orderBy("start", "end", "text")) - 1).cast("long"))
    for c in ("label", "left_context", "right_context"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select("text_idx", "mention_idx", "text", "label", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
                     F.coalesce("left_context", F.lit("")).alias("left_context"), F.coalesce("right_context", F.lit("")).alias("right_context"))


def filter_by_length(mentions: DataFrame, min_length: int = 2) -> DataFrame:
    return mentions.filter(F.length("text") >= min_length)


def deduplicate(mentions: DataFrame) -> DataFrame:
    """The first mention of each span."""
    return keep_first(mentions, ["text_idx", "start", "end"], "mention_idx")


def sort_by_position(mentions: DataFrame) -> DataFrame:
    """mention_idx, the order of a text's mentions, follows the starts, ties as they were."""
    w = Window.partitionBy("text_idx").orderBy("start", "mention_idx")
    return mentions.withColumn("mention_idx", (F.row_number().over(w) - 1).cast("long"))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return ~((a_end <= b_start) | (a_start >= b_end))


#: Characters of a bin in which spans of a text meet.
BIN = 64


def free_of(extra: DataFrame, mentions: DataFrame, width: int = BIN) -> DataFrame:
    """Rows of `extra` that overlap no mention of their text. Spans meet in bins of `width` characters; a bin keeps, of
    the mentions that begin before it, only the end that reaches furthest, and of those that begin in it their
    places: so a bin has as many pairs as spans begin in it, and a long mention one row a bin. An empty span
    overlaps those that hold its place within them, as the rule of intervals has it."""
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    last = F.greatest(at("start"), F.floor((F.col("end") - 1) / width).cast("long"))
    m = mentions.select("text_idx", "start", "end").distinct().select("text_idx", "start", "end", F.explode(F.sequence(at("start"), last)).alias("bin"))
    inside = m.filter(F.col("bin") == at("start")).select("text_idx", "bin", F.col("start").alias("_s"), F.col("end").alias("_e"))
    reach = m.filter(F.col("bin") > at("start")).groupBy("text_idx", "bin").agg(F.max("end").alias("_reach"))
    x = extra.select("text_idx", "start", "end").distinct().select("text_idx", "start", "end", F.explode(F.sequence(at("start"), last)).alias("bin"))
    hit = x.join(inside, ["text_idx", "bin"]).filter(overlaps(F.col("start"), F.col("end"), F.col("_s"), F.col("_e")))
    late = x.join(reach, ["text_idx", "bin"]).filter((F.col("start") < F.col("_reach")) & ((F.col("end") > F.col("bin") * width) | (F.col("start") >= F.col("bin") * width)))
    taken = hit.select("text_idx", "start", "end").unionByName(late.select("text_idx", "start", "end")).distinct()
    return extra.join(taken, ["text_idx", "start", "end"], "left_anti").select(extra.columns)


def add_non_overlapping(mentions: DataFrame, extra: DataFrame, min_length: int = 2, label: str = "NOUN_CHUNK") -> DataFrame:
    """Mentions of `extra` (noun chunks) of enough length that overlap none of the mentions, added after them."""
    free = free_of(filter_by_length(extra, min_length), mentions)
    after = mentions.groupBy("text_idx").agg((F.max("mention_idx") + 1).alias("shift"))
    free = free.join(after, "text_idx", "left").withColumn("mention_idx", F.col("mention_idx") + F.coalesce("shift", F.lit(0))).withColumn("label", F.lit(label)).drop("shift")
    return mentions.unionByName(free.select(mentions.columns))


def differs_from_label(mentions: DataFrame) -> DataFrame:
    """Mentions whose text isn't just their own type."""
    return mentions.filter(~F.coalesce(F.lower("text") == F.lower("label"), F.lit(False)))


METHODS = {"filter_by_length": filter_by_length, "deduplicate": deduplicate, "sort_by_position": sort_by_position}
DEFAULT = [("deduplicate", {}), ("sort_by_position", {})]
