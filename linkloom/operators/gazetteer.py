"""Names of a knowledge base found in texts: every place where one stands, whatever its length and signs.

A name matches without regard to case where no letter or digit touches it; at an end of the name that is a sign (the
plus of `C++`) anything may follow. Gazetteers within a size that is checked become an Aho-Corasick automaton, built
once in each worker from a broadcast list, and texts are read once, without a shuffle. Larger ones stay distributed:
places where a name's first token stands meet the lengths of names that begin so, and what is written there meets the
names, by equi-joins."""

from __future__ import annotations

import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MENTIONS
from ..session import pieces
from .mentions import mention_batches, tokens

#: Characters of names that are broadcast at most, and names.
MOST_CHARS = 32 << 20
MOST_NAMES = 1 << 20
_automata: dict[str, object] = {}


def fold(text: str) -> str:
    """Lower case, a character for each character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _clear(text: str, start: int, end: int) -> bool:
    """Does no letter or digit touch the span at an end that is itself one?"""
    return not (start and text[start].isalnum() and text[start - 1].isalnum()) and not (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


def _automaton(key: str, names: bytes):
    if key not in _automata:
        import ahocorasick

        _automata.clear()  # workers outlive a plan: only the last gazetteer stays
        a = ahocorasick.Automaton()
        for name in map(fold, pa.ipc.open_stream(io.BytesIO(names)).read_all().column(0).to_pylist()):
            if name:
                a.add_word(name, len(name))
        if len(a):
            a.make_automaton()
        _automata[key] = a
    return _automata[key]


def _spans(text: str, a) -> list[tuple[int, int]]:
    """Where names stand in a text, ascending."""
    return sorted((e + 1 - n, e + 1) for e, n in a.iter(fold(text)) if _clear(text, e + 1 - n, e + 1)) if len(a) else []


def _by_automaton(texts: DataFrame, names: DataFrame, left: int, right: int) -> DataFrame:
    t, out, name = names.toArrow(), io.BytesIO(), uuid.uuid4().hex
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    shipped = texts.sparkSession.sparkContext.broadcast(out.getvalue())

    def run(batches):
        a = _automaton(name, shipped.value)
        found = ((i, k, text, s, e, None) for b in pieces(batches) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, (s, e) in enumerate(_spans(text or "", a)))
        yield from mention_batches(found, left, right)

    return texts.select(F.col("text_idx").cast("long"), "text").mapInArrow(run, MENTIONS)


#: A name's first token: a word, or one sign.
FIRST = r"^[\p{L}\p{N}]+|^."


def _by_joins(texts: DataFrame, names: DataFrame, left: int, right: int) -> DataFrame:
    names = names.select("key", F.regexp_extract("key", "(?s)" + FIRST, 0).alias("first"))
    lengths = names.groupBy("first").agg(F.collect_set(F.length("key")).alias("lengths"))
    t = tokens(texts)
    word = F.col("token").rlike(r"^[\p{L}\p{N}]")
    signs = F.transform(F.sequence(F.lit(1), F.length("token")), lambda k: F.struct(F.substring("token", k, F.lit(1)).alias("token"), (F.col("start") + k - 1).alias("start")))
    places = t.select("text_idx", F.explode(F.when(word, F.array(F.struct("token", "start"))).otherwise(signs)).alias("x")).select("text_idx", F.lower("x.token").alias("first"), "x.start")
    places = places.join(lengths, "first").groupBy("text_idx").agg(F.collect_list(F.struct("start", "lengths")).alias("places"))
    at = places.join(texts, "text_idx").select("text_idx", "text", F.explode("places").alias("p")).select("text_idx", "text", "p.start", F.explode("p.lengths").alias("n"))
    span = F.substring("text", F.col("start") + 1, F.col("n"))
    around = F.substring("text", F.greatest(F.col("start"), F.lit(1)), F.lit(2)), F.substring("text", F.col("start") + F.col("n"), F.lit(2))
    two = r"^[\p{L}\p{N}]{2}$"
    at = at.filter((F.length(span) == F.col("n")) & ~((F.col("start") > 0) & around[0].rlike(two)) & ~around[1].rlike(two))
    before = F.substring("text", F.greatest(F.col("start") - left, F.lit(0)) + 1, F.least(F.col("start"), F.lit(left)))
    at = at.select("text_idx", span.alias("found"), "start", before.alias("before"), F.substring("text", F.col("start") + F.col("n") + 1, F.lit(right)).alias("after"))
    hit = at.withColumn("key", F.lower("found")).join(names.select("key"), "key", "left_semi")
    from pyspark.sql import Window

    from ..schema import strip

    hit = hit.select("text_idx", F.col("found").alias("text"), F.lit(None).cast("string").alias("label"), F.col("start").cast("int").alias("start"), (F.col("start") + F.length("found")).cast("int").alias("end"),
                     strip(F.col("before")).alias("left_context"), strip(F.col("after")).alias("right_context"))
    return hit.withColumn("mention_idx", (F.row_number().over(Window.partitionBy("text_idx").orderBy("start", "end")) - 1).cast("long")).select(MENTIONS.names)


def gazetteer_mentions(texts: DataFrame, surfaces: DataFrame, left: int = 50, right: int = 50, most_chars: int = MOST_CHARS, most_names: int = MOST_NAMES) -> DataFrame:
    """All places where a name (surfaces.key) stands in the texts, overlapping ones too, by start and end. Null and
    empty texts and names have none."""
    names = surfaces.select(F.lower("key").alias("key")).filter("key <> ''").distinct()
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("chars")).first()
    return (_by_automaton if size["n"] <= most_names and size["chars"] <= most_chars else _by_joins)(texts, names, left, right)
