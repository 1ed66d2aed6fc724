"""Row types and small helpers that keep order-dependent steps explicit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that Python's str.strip removes.
WHITE = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

ENTITY = T.StructType([
    T.StructField("entity_id", T.StringType(), False), T.StructField("label", T.StringType(), False),
    T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("description", T.StringType()),
    T.StructField("entity_type", T.StringType()), T.StructField("popularity", T.LongType()),
    T.StructField("metadata", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embedding_model_id", T.StringType())])
TEXTS = T.StructType([T.StructField("text_idx", T.LongType()), T.StructField("text", T.StringType())])
MENTIONS = T.StructType([
    T.StructField("text_idx", T.LongType()), T.StructField("mention_idx", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("left_context", T.StringType()), T.StructField("right_context", T.StringType())])
LINKS = T.StructType([
    T.StructField("text_idx", T.LongType()), T.StructField("link_ord", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("score", T.DoubleType()), T.StructField("class_probs", T.MapType(T.StringType(), T.DoubleType()))])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def norm(c: Column) -> Column:
    """Lower case without white space at the ends, the form in which queries are looked up."""
    return F.lower(strip(c))


FIELD = re.compile(r"\{\{|\}\}|\{([^{}]*)\}")


def template_fields(template: str) -> list[str]:
    return [m[1] for m in FIELD.finditer(template) if m[1] is not None]


def template(text: str, columns: list[str], fallback: str = "label") -> Column:
    """A `{field}` template as a Column. A field that the rows lack gives the fallback column for the whole, as
    formatting a record without it does; anything but plain fields is refused when the plan is built."""
    if any(not re.fullmatch(r"\w+", f) for f in template_fields(text)):
        raise ValueError(f"only plain {{field}} templates are supported: {text!r}")
    if any(f not in columns for f in template_fields(text)):
        return F.col(fallback)
    parts, at = [], 0
    for m in FIELD.finditer(text):
        parts.append(F.lit(text[at: m.start()]))
        parts.append(F.lit(m[0][0]) if m[1] is None else F.coalesce(F.col(m[1]).cast("string"), F.lit("None")))
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row of each key, the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_k(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")
