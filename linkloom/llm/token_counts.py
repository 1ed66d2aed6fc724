"""Token counts by a map-side two-tier lookup: a broadcast table of the lengths of frequent pre-tokens, then
a bounded cache in each worker whose misses are encoded by the tokenizer. No pre-token is ever shuffled.

A pre-token here is a run of white space with the run of other characters that follows it. No token of a
byte-level BPE file with the usual pattern crosses the end of such a run, so a text's count is the sum of
its pre-tokens' counts. Special strings inside texts count as the library's default has them: one token."""

from __future__ import annotations

import io
import json
import os
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import small_batches, state_key, worker_state

#: The characters with Unicode's White_Space property.
WHITE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CACHE_BYTES = 64 << 20  # characters of pre-tokens in a worker's cache, besides their number
PRE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def check_pattern(tok) -> None:
    """Refuse tokenizers whose tokens may go over the end of a pre-token: all but byte-level ones that cut texts by
    the usual pattern and change nothing before."""
    spec = json.loads(tok.to_str())
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
        raise ValueError("only byte-level tokenizers with the usual pattern are counted by pre-tokens")


class _Counts(dict):
    """Pre-tokens to their counts, with what was asked for in vain: that is 0, and noted in `missing`."""

    def __init__(self, first: dict):
        super().__init__(first)
        self.missing: list[str] = []

    def __missing__(self, word):
        self.missing.append(word)
        return 0


class Lengths:
    """Both tiers in one worker. cache_entries and CACHE_BYTES bound the second."""

    def __init__(self, path: str, table: bytes, cache_entries: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        check_pattern(self.tok)
        self.specials = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        t = pa.ipc.open_stream(io.BytesIO(table)).read_all()
        self.first = dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist()))
        self.cache, self.before, self.most = _Counts(self.first), {}, len(self.first) + cache_entries // 2
        self.bytes = 0

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and the number of special strings between them."""
        if self.cut is None or not self.cut.search(text):
            return PRE.findall(text), 0
        parts = self.cut.split(text)
        return [p for x in parts for p in PRE.findall(x)], len(parts) - 1

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.cache) > self.most or self.bytes > CACHE_BYTES:  # two generations: what is met again comes back from the older one
            self.before, self.cache, self.bytes = dict(self.cache), _Counts(self.first), 0
        out, late = [], []
        get, missing = self.cache.__getitem__, self.cache.missing
        n_missing = 0
        for t in texts:
            pre, n = self.pieces(t)
            out.append(n + sum(map(get, pre)))
            if missing:
                late.append((len(out) - 1, missing[:]))
                n_missing += len(missing)
                missing.clear()
                if n_missing > 200_000:
                    self._settle(late, out)
                    n_missing = 0
        self._settle(late, out)
        return out

    def _settle(self, late: list, out: list) -> None:
        """Add the counts of pre-tokens that weren't in the cache."""
        words = []
        for w in set().union(*(ws for _, ws in late)):
            n = self.before.get(w)
            if n is None:
                words.append(w)
            else:
                self.cache[w] = n
        for at in range(0, len(words), 4096):
            part = words[at: at + 4096]
            self.cache.update(zip(part, (len(e.ids) for e in self.encode(part, add_special_tokens=False))))
            self.bytes += sum(map(len, part))
        for i, ws in late:
            out[i] += sum(map(self.cache.__getitem__, ws))
        late.clear()


def frequent_table(docs: DataFrame, path: str, size: int, sample_docs: int, text: str = "text") -> bytes:
    """The first tier: up to `size` of the pre-tokens met most often in a sample of about `sample_docs` texts,
    with their token counts, as an Arrow stream. It decides only which lookups are fast, never a result."""
    from tokenizers import Tokenizer

    n = docs.count()
    part = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    part = part.sample(min(1.0, sample_docs / n), 7) if n else part

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(PRE.findall(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    total = part.mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1")
    words = [r["w"] for r in total.orderBy(F.col("n").desc(), "w").limit(size).collect()]  # of the sample's words, `size` at most
    tok = Tokenizer.from_file(path)
    specials = {t.content for t in tok.get_added_tokens_decoder().values()}
    words = [w for w in words if not any(s in w for s in specials)]
    table = pa.table({"w": pa.array(words, pa.string()), "n": pa.array([len(e.ids) for e in tok.encode_batch(words, add_special_tokens=False)], pa.int64())})
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue()


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", table_size: int = 1 << 16, sample_docs: int = 2000, cache_entries: int = 400_000, keep: list[str] | None = None) -> DataFrame:
    """`docs` (of its columns those in `keep`, else all) with n_tokens long. A null text counts as empty and has
    0 tokens; other columns, whatever their names, pass through (a column n_tokens is replaced); rows that
    repeat are counted each; an empty table gives an empty result."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_tokens") if "n_tokens" in docs.columns else docs
    table, name = spark.sparkContext.broadcast(frequent_table(docs, tokenizer_path, table_size, sample_docs, text)), state_key("lengths")
    at = docs.columns.index(text)
    out = [i for i, c in enumerate(docs.columns) if keep is None or c in keep]

    def run(batches):
        state = worker_state(name, lambda: Lengths(tokenizer_path, table.value, cache_entries))
        for b in batches:
            n = state.counts([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in out), pa.array(n, pa.int64())], names=[*(b.schema.names[i] for i in out), "n_tokens"])

    return docs.mapInArrow(run, StructType([*(docs.schema.fields[i] for i in out), StructField("n_tokens", LongType())]))
