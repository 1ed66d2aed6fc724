"""The path, reduce, filter and template languages of pipeline inputs.

Each works on plain values at the edges of a pipeline (resolve, reduce_values, filter_values, format_values), and
on DataFrames as a compiled Column or filter (path_column, reduce_column, filter_frame)."""

from __future__ import annotations

import operator
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = re.compile(r"([^.\[\]]+)|\[(\*|-?\d*:-?\d*|-?\d+)\]|\.")
OPS = {">=": operator.ge, "<=": operator.le, "==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt}
EXPR = re.compile(r"^\s*(\w+)\s*(>=|<=|==|!=|>|<)\s*(.+?)\s*$")


def parse_path(path: str) -> list[str | int | slice]:
    """Names, indexes, slices and '*' of a path such as a[*].b or a[1:3]."""
    out: list[str | int | slice] = []
    at = 0
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise ValueError(f"bad path {path!r}")
        at = m.end()
        if m[1]:
            out.append(m[1])
        elif m[2] == "*":
            out.append(slice(None))
        elif m[2] and ":" in m[2]:
            a, b = m[2].split(":")
            out.append(slice(int(a) if a else None, int(b) if b else None, 1))
        elif m[2]:
            out.append(int(m[2]))
    return out


def _get(value: Any, name: str) -> Any:
    if isinstance(value, list):
        return [_get(v, name) for v in value]
    if isinstance(value, dict):
        return value.get(name)
    return getattr(value, name, None)


def resolve(data: Any, path: str) -> Any:
    """Follow a path; None anywhere gives None; an index outside raises; [*] makes a list of what is none."""
    for step in parse_path(path):
        if data is None:
            return None
        if isinstance(step, str):
            data = _get(data, step)
        elif isinstance(step, slice) and step == slice(None):
            data = data if isinstance(data, list) else [data]
        else:
            data = data[step]
    return data


def _child(dtype: T.DataType, name: str) -> T.DataType:
    while isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    return dtype[name].dataType if isinstance(dtype, T.StructType) else dtype.valueType


def _field(c: Column, dtype: T.DataType, name: str) -> tuple[Column, T.DataType]:
    if isinstance(dtype, T.ArrayType):
        inner: list[T.DataType] = []

        def one(x: Column) -> Column:
            y, t = _field(x, dtype.elementType, name)
            inner.append(t)
            return y

        out = F.transform(c, one)
        return out, T.ArrayType(inner[0])
    return c.getField(name) if isinstance(dtype, T.StructType) else c.getItem(name), _child(dtype, name)


def path_column(schema: T.StructType, path: str) -> Column:
    """The path as a Column over rows of a schema. Indexes outside give null here."""
    steps = parse_path(path)
    c, dtype = F.col(f"`{steps[0]}`"), schema[steps[0]].dataType
    for step in steps[1:]:
        if isinstance(step, str):
            c, dtype = _field(c, dtype, step)
        elif isinstance(step, int):
            c, dtype = F.try_element_at(c, F.lit(step + 1 if step >= 0 else step)), dtype.elementType
        elif step == slice(None):
            if not isinstance(dtype, T.ArrayType):
                c, dtype = F.array(c), T.ArrayType(dtype)
        else:
            n = F.size(c)
            place = lambda v, default: F.lit(default) if v is None else F.lit(v) if v >= 0 else F.greatest(n + v, F.lit(0))
            a = place(step.start, 0)
            b = n if step.stop is None else place(step.stop, 0)
            c = F.slice(c, a + 1, F.greatest(F.least(b, n) - a, F.lit(0)))
    return c


def flatten(values: Any) -> list:
    return [x for v in values for x in (flatten(v) if isinstance(v, list) else [v])]


def reduce_values(values: Any, how: str) -> Any:
    """first and last element (None of an empty list), or all: nested lists made one."""
    if not isinstance(values, list):
        return values
    if how in ("first", "last"):
        return values[0 if how == "first" else -1] if values else None
    if how == "all":
        return flatten(values)
    raise ValueError(f"unknown reduce mode {how!r}")


def reduce_column(c: Column, how: str, depth: int = 1) -> Column:
    if how in ("first", "last"):
        return F.try_element_at(c, F.lit(1 if how == "first" else -1))
    for _ in range(depth - 1):
        c = F.flatten(c)
    return c


def parse_filter(expr: str) -> tuple[str, str, Any] | None:
    """field, operator and literal: quoted is text, with a point a float, else an integer, else the bare text."""
    m = EXPR.match(expr)
    if not m:
        return None
    raw: Any = m[3]
    if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "'\"":
        return m[1], m[2], raw[1:-1]
    for kind in (float,) if "." in raw else (int,):
        try:
            return m[1], m[2], kind(raw)
        except ValueError:
            pass
    return m[1], m[2], raw


def filter_values(values: Any, expr: str) -> Any:
    """Items for which the expression holds; items without a value or with one of another type go; what is no
    list, or an expression that can't be read, changes nothing."""
    parsed = parse_filter(expr)
    if parsed is None or not isinstance(values, list):
        return values
    field, op, want = parsed
    out = []
    for v in values:
        got = _get(v, field)
        try:
            if got is not None and OPS[op](got, want):
                out.append(v)
        except TypeError:
            pass
    return out


def filter_frame(df: DataFrame, expr: str) -> DataFrame:
    parsed = parse_filter(expr)
    if parsed is None:
        return df
    field, op, want = parsed
    text = isinstance(df.schema[field].dataType, T.StringType)
    if text != isinstance(want, str) and op not in ("!=", "=="):
        return df.limit(0)
    if text != isinstance(want, str):  # values of unlike types are never equal
        return df.limit(0) if op == "==" else df.filter(F.col(field).isNotNull())
    return df.filter(OPS[op](F.col(field), F.lit(want)))


def format_values(values: Any, text: str) -> Any:
    """The template over one item or each of a list; what can't be formatted becomes its str()."""
    def one(v: Any) -> str:
        try:
            return text.format(**(v if isinstance(v, dict) else vars(v)))
        except (KeyError, IndexError, ValueError, TypeError, AttributeError):
            return str(v)

    return [one(v) for v in values] if isinstance(values, list) else one(values)
