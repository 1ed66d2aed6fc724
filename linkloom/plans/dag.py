"""Pipelines as graphs of nodes: parsing, order, lazy execution, and the context of results."""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType

from ..functions import paths
from ..schema import template
from ..session import cut, prepare
from ..sources import kb
from . import processors  # noqa: F401  (registers the layers)
from .registry import get


@dataclass
class Input:
    """Where an argument comes from. source: an output key, a node id, `$input` or `outputs[i]`."""

    source: str
    fields: str | None = None
    reduce: str = "all"
    filter: str | None = None
    template: str | None = None
    default: Any = None


@dataclass
class Node:
    id: str
    processor: str
    inputs: dict[str, Input] = field(default_factory=dict)
    output: str = ""
    output_fields: list[str] | None = None
    requires: list[str] = field(default_factory=list)
    config: dict = field(default_factory=dict)
    schema: dict = field(default_factory=dict)
    condition: Any = True


def parse(config: dict) -> list[Node]:
    out = []
    for n in config.get("nodes", []):
        for key in ("id", "processor", "inputs", "config", "output"):
            if key not in n:
                raise ValueError(f"node {n.get('id')!r} has no {key!r}")
        ins = {k: Input(**{a: b for a, b in (v if isinstance(v, dict) else {"source": v}).items() if a in Input.__dataclass_fields__}) for k, v in n["inputs"].items()}
        o = n["output"] if isinstance(n["output"], dict) else {"key": n["output"]}
        fields = o.get("fields")
        out.append(Node(n["id"], n["processor"], ins, o.get("key", n["id"]), [fields] if isinstance(fields, str) else fields, list(n.get("requires", [])), n["config"], n.get("schema", {}) or {}, n.get("condition", True)))
    return out


def levels(nodes: list[Node]) -> list[list[str]]:
    """Nodes level by level, in list order within one; edges are requirements and sources, by id or output key."""
    ids = {n.id for n in nodes}
    by_key = {n.output: n.id for n in nodes} | {i: i for i in ids}
    need: dict[str, set[str]] = {}
    for n in nodes:
        unknown = [r for r in n.requires if r not in by_key]
        if unknown:
            raise ValueError(f"node {n.id!r} requires unknown {unknown}")
        roots = {re.split(r"[.\[]", x.source)[0] for x in n.inputs.values()}
        need[n.id] = ({by_key[r] for r in n.requires} | {by_key[r] for r in roots if r in by_key}) - {n.id}
    out, done = [], set()
    while len(done) < len(nodes):
        ready = [n.id for n in nodes if n.id not in done and need[n.id] <= done]
        if not ready:
            raise ValueError(f"cycle among {sorted(ids - done)}")
        out.append(ready)
        done |= set(ready)
    return out


class Context:
    """Results by key, in the order in which they came."""

    def __init__(self, given: Any = None):
        self._input, self._data, self._meta = given, {}, {}

    def set(self, key: str, value: Any, metadata: dict | None = None) -> None:
        self._data[key] = value
        if metadata:
            self._meta[key] = metadata

    def get(self, source: str) -> Any:
        if source == "$input":
            return self._input
        m = re.fullmatch(r"outputs\[(-?\d+)\]", source)
        if m:
            vals, i = list(self._data.values()), int(m[1])
            return vals[i] if -len(vals) <= i < len(vals) else None
        return self._data.get(source)

    def has(self, key: str) -> bool:
        return key == "$input" and self._input is not None or key in self._data

    def get_all_outputs(self) -> dict:
        return dict(self._data)

    def get_metadata(self, key: str) -> dict | None:
        return self._meta.get(key)

    def get_execution_order(self) -> list[str]:
        return list(self._data)

    def resolve(self, x: Input) -> Any:
        """Source, then fields, template, reduce and filter; the default stands in for a missing source only."""
        v = self.get(x.source)
        if v is None:
            return x.default
        if isinstance(v, DataFrame):
            return self._resolve_frame(v, x)
        if x.fields:
            v = paths.resolve(v, x.fields)
        if x.template and v is not None:
            v = paths.format_values(v, x.template)
        if isinstance(v, list):
            v = paths.reduce_values(v, x.reduce)
        return paths.filter_values(v, x.filter) if x.filter else v

    @staticmethod
    def _resolve_frame(v: DataFrame, x: Input) -> DataFrame:
        """The same on the rows of a frame: a path or column becomes a column named after its last field beside
        text_idx, a template the column `value`, reduce works within each row's list. A filter sees all columns."""
        v = paths.filter_frame(v, x.filter) if x.filter else v
        if not x.fields and not x.template:
            return v
        root = re.split(r"[.\[]", x.fields)[0] if x.fields else None
        if root is not None and root not in v.columns:
            return v
        keep = ["text_idx"] if "text_idx" in v.columns and x.fields != "text_idx" else []
        if x.fields:
            c = paths.path_column(v.schema, x.fields)
            name = re.split(r"[.\[]", re.sub(r"\[[^\]]*\]", "", x.fields))[-1]
            if x.reduce != "all" and isinstance(v.select(c).schema[0].dataType, ArrayType):
                c = paths.reduce_column(c, x.reduce)
            v = v.select(*keep, c.alias(name))
        if x.template:
            v = v.select(*keep, template(x.template, v.columns, v.columns[-1]).alias("value"))
        return v

    def save(self, folder: str) -> None:
        """DataFrames as Parquet and a manifest with the other values."""
        meta = {k: {a: b for a, b in m.items() if not isinstance(b, DataFrame)} for k, m in self._meta.items()}
        manifest: dict = {"saved_at": datetime.datetime.now().isoformat(), "order": list(self._data), "metadata": meta, "values": {}, "frames": []}
        for k, v in self._data.items():
            if isinstance(v, DataFrame):
                v.write.mode("overwrite").parquet(f"{folder}/{k}")
                manifest["frames"].append(k)
            else:
                manifest["values"][k] = v
        # The manifest goes where the frames go, by the same file system.
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(manifest, default=str, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Context:
        m = json.loads(spark.read.text(f"{folder}/manifest", wholetext=True).first()["value"])
        out = cls()
        for k in m["order"]:
            out.set(k, spark.read.parquet(f"{folder}/{k}") if k in m["frames"] else m["values"][k], m["metadata"].get(k))
        return out


class Executor:
    """A compiled pipeline. execute() builds DataFrames; the outputs that other nodes read are written once, so plans
    stay small, and the rest runs when it is read. Nodes that nothing needs can be left out by their condition."""

    def __init__(self, config: dict | list[Node], spark: SparkSession):
        self.spark = prepare(spark)
        self.nodes = parse(config) if isinstance(config, dict) else config
        self.order = levels(self.nodes)
        self.processors = {}
        for n in self.nodes:
            try:
                p = get(n.processor)(n.config, spark)
            except Exception as e:
                raise RuntimeError(f"node {n.id!r}: {e}") from e
            p.schema = n.schema
            self.processors[n.id] = p
        for chain in self._chains()[:1]:
            for p in self.processors.values():
                if hasattr(type(p), "chain") and p.chain is None:
                    p.chain = chain

    def _chains(self):
        """The knowledge bases of the L2 nodes."""
        return [self.processors[n.id].chain for n in self.nodes if n.processor == "l2_chain"]

    def load_entities(self, source: Any = None, target_layers: list[str] | None = None, overwrite: bool = False, filepath: str | None = None, batch_size: int = 1000) -> dict[str, int]:
        rows = cut(kb.load_source(self.spark, source if source is not None else filepath))
        out: dict[str, int] = {}
        for c in self._chains():
            out |= c.load(rows, target_layers, overwrite)
        return out

    def clear_databases(self) -> None:
        for c in self._chains():
            c.clear()

    def count_entities(self) -> dict[str, int]:
        return {k: v for c in self._chains() for k, v in c.counts().items()}

    def precompute_embeddings(self, encode, model_id: str, target_layers: list[str] | None = None) -> dict[str, int]:
        """Vectors of all labels, formatted by the schema of L2, else of L3."""
        text = next((n.schema["template"] for kind in ("l2_chain", "l3_batch") for n in self.nodes if n.processor == kind and n.schema.get("template")), "{label}")
        return {k: v for c in self._chains() for k, v in c.precompute(encode, text, model_id, target_layers).items()}

    def execute(self, given: dict) -> Context:
        """given: texts (a DataFrame text_idx, text, or a list of strings) and maybe entities (mentions)."""
        if isinstance(given.get("texts"), list):
            given = given | {"texts": self.spark.createDataFrame(list(enumerate(given["texts"])), "text_idx long, text string")}
        if isinstance(given.get("entities"), list):
            from ..operators.mentions import external_mentions

            def parts(e: Any) -> tuple:
                """Text, start and end of a mention: a dict, an object, or a text alone."""
                if isinstance(e, str):
                    return e, None, None
                return tuple(e.get(k) if isinstance(e, dict) else getattr(e, k, None) for k in ("text", "start", "end"))

            rows = [(i, k, *parts(e)) for i, es in enumerate(given["entities"]) for k, e in enumerate(es)]
            given = given | {"entities": external_mentions(self.spark.createDataFrame(rows, "text_idx long, mention_idx long, text string, start int, end int"))}
        ctx = Context(given)
        by_id = {n.id: n for n in self.nodes}
        for level in self.order:
            for i in level:
                n = by_id[i]
                if not (ctx.get(n.condition) is not None if isinstance(n.condition, str) else n.condition):
                    continue
                try:
                    kw = {}
                    for name, x in n.inputs.items():
                        v = ctx.resolve(x)
                        kw[name] = v.get(name) if isinstance(v, dict) and x.source == "$input" and not x.fields else v
                except Exception as e:
                    raise ValueError(f"inputs of node {n.id!r}: {e}") from e
                try:
                    out = self.processors[i](**kw)
                except Exception as e:
                    raise RuntimeError(f"node {n.id!r}: {e}") from e
                if any(x.source.split("[")[0].split(".")[0] in (n.output, n.id) for m in self.nodes for x in m.inputs.values()):
                    out = cut(out)
                stats = {"stats": self.processors[i].stats(out)} if hasattr(self.processors[i], "stats") else {}
                ctx.set(n.output, out.select(*n.output_fields) if n.output_fields else out, {"node": n.id} | stats)
        return ctx
