"""Knowledge-base records: reading, layers of storage, loading and updating.

A layer is a DataFrame of records with a load position; every change gives a new one. Which of several rows of
an id stands is always decided by load positions, never by the order in which rows happen to lie."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTITY, keep_first
from ..session import cut


def _complete(df: DataFrame, source: str | None = None) -> DataFrame:
    """All columns of a record with their defaults; unknown columns go."""
    fill = {"aliases": F.array().cast("array<string>"), "description": F.lit(""), "entity_type": F.lit(""), "popularity": F.lit(0).cast("long"), "metadata": F.lit("{}"), "source": F.lit("")}
    cols = []
    for f in ENTITY.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        c = F.coalesce(c, fill[f.name]) if f.name in fill else c
        cols.append((F.lit(source) if f.name == "source" and source is not None else c).alias(f.name))
    order = F.col("load_ord").cast("long") if "load_ord" in df.columns else F.monotonically_increasing_id()
    return df.select(*cols, order.alias("load_ord")).filter("entity_id is not null and label is not null")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One record per line; blank and broken lines and records without id or label are passed over. The load
    position follows the lines of a file."""
    lines = spark.read.text(path).withColumn("load_ord", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    got = lines.withColumn("r", F.from_json("value", ENTITY, {"mode": "PERMISSIVE"})).filter("r is not null")
    return _complete(got.select("r.*", "load_ord"))


def read_records(spark: SparkSession, rows: list[Any]) -> DataFrame:
    """Dicts or objects in list order."""
    names = ENTITY.fieldNames()
    data = []
    for i, r in enumerate(rows):
        d = r if isinstance(r, dict) else vars(r)
        data.append(tuple(json.dumps(d[n]) if n == "metadata" and isinstance(d.get(n), dict) else d.get(n) for n in names) + (i,))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENTITY.fields) + ", load_ord long"
    return _complete(spark.createDataFrame(data, schema))


def read_mapping(spark: SparkSession, records: dict[str, dict]) -> DataFrame:
    """A dict of dicts: the key is the entity_id where a record has none."""
    return read_records(spark, [v if v.get("entity_id") else v | {"entity_id": k} for k, v in records.items()])


def load_source(spark: SparkSession, source: Any) -> DataFrame:
    """Records from a path of JSON lines, a list, a dict of dicts or a DataFrame."""
    if isinstance(source, DataFrame):
        return _complete(source)
    if isinstance(source, str) or hasattr(source, "__fspath__"):
        return read_jsonl(spark, str(source))
    if isinstance(source, dict):
        return read_mapping(spark, source)
    if isinstance(source, list):
        return read_records(spark, source)
    raise TypeError(f"can't load entities from {type(source).__name__}")


def map_fields(raw: DataFrame, mapping: dict[str, str], source: str = "") -> DataFrame:
    """Rows of a store as records: mapping gives the store's column of each standard field."""
    cols = [F.col(mapping.get(n, n)).alias(n) for n in ENTITY.fieldNames() if mapping.get(n, n) in raw.columns and n != "source"]
    keep = [F.col("load_ord")] if "load_ord" in raw.columns else []
    return _complete(raw.select(*cols, *keep), source)


def unmap_fields(records: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Records as rows of a store: the mapping's fields under the store's names, and the load position."""
    return records.select(*[F.col(n).alias(c) for n, c in mapping.items() if n in records.columns], *(["load_ord"] if "load_ord" in records.columns else []))


def upsert(old: DataFrame | None, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """Records after a load: of rows with one id the first stays, or with overwrite the last."""
    rows = new.withColumn("_new", F.lit(1))
    if old is not None:
        rows = old.withColumn("_new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    order = [F.col("_new").desc(), F.col("load_ord").desc()] if overwrite else [F.col("_new"), F.col("load_ord")]
    return keep_first(rows, ["entity_id"], *order).drop("_new")


def surface_forms(records: DataFrame) -> DataFrame:
    """(entity_id, key, kind, load_ord): lower-cased labels and aliases, each once per entity and kind."""
    label = records.select("entity_id", F.lower("label").alias("key"), F.lit("label").alias("kind"), "load_ord")
    alias = records.select("entity_id", F.explode("aliases").alias("a"), "load_ord").select("entity_id", F.lower("a").alias("key"), F.lit("alias").alias("kind"), "load_ord").distinct()
    return label.unionByName(alias)


def label_index(records: DataFrame) -> DataFrame:
    """(key, entity_id): the record loaded last under each label."""
    return records.groupBy(F.lower("label").alias("key")).agg(F.max_by("entity_id", F.struct("load_ord", "entity_id")).alias("entity_id"))


def key_values(records: DataFrame, ttl: int = 0, now: str | None = None) -> DataFrame:
    """A key-value table: one row for each label and alias, the record as JSON, and when it expires (null for a
    ttl of 0)."""
    at = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    expires = at + F.make_dt_interval(secs=F.lit(ttl)) if ttl else F.lit(None).cast("timestamp")
    key = F.explode(F.array_distinct(F.transform(F.concat(F.array("label"), "aliases"), lambda x: F.lower(x)))).alias("key")
    rec = F.to_json(F.struct(*[F.col(n) for n in ENTITY.fieldNames()]))
    return records.select(key, rec.alias("value"), expires.alias("expires_at"), "load_ord")


def update_embeddings(records: DataFrame, vectors: DataFrame, model_id: str) -> DataFrame:
    """Records with the vectors (entity_id, embedding) of a model; ids that are not there change nothing."""
    v = vectors.select("entity_id", F.col("embedding").cast("array<float>").alias("_v"))
    got = records.join(v, "entity_id", "left")
    return got.withColumn("embedding_model_id", F.when(F.col("_v").isNotNull(), F.lit(model_id)).otherwise(F.col("embedding_model_id"))) \
        .withColumn("embedding", F.coalesce("_v", "embedding")).drop("_v")


@dataclass
class Layer:
    """One store of the chain. kind: dict, redis (key-value), elasticsearch (full text) or postgres (trigram and
    substring search); priority: higher is asked first."""

    name: str
    kind: str = "dict"
    priority: int = 0
    write: bool = True
    search_mode: list[str] = field(default_factory=lambda: ["exact"])
    ttl: int = 0
    cache_policy: str = "always"
    field_mapping: dict[str, str] = field(default_factory=dict)
    fuzzy: dict[str, Any] = field(default_factory=dict)
    available: bool = True
    records: DataFrame | None = None
    config: dict[str, Any] = field(default_factory=dict)
    cached: DataFrame | None = None  # of a key-value store: rows (key, value, expires_at, load_ord) that answers wrote
    turns: int = 0  # how often answers were written
    keys: Any = None  # a stored index of the records' names (stored.KeyStore), kept with every change

    def key_values(self, now: str | None = None) -> DataFrame:
        """The table of a key-value store: records under their labels and aliases; an answer that was written under a
        key stands in their place as long as it lasts."""
        rows = key_values(self.records, self.ttl, now)
        if self.cached is None:
            return rows
        at = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
        live = self.cached.filter(F.col("expires_at") > at)
        return rows.join(live.select("key"), "key", "left_anti").unionByName(live)

    def found_records(self) -> DataFrame:
        """The records that a search can give: with those of answers that were written under keys."""
        if self.cached is None:
            return self.records
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENTITY.fields)
        rows = self.cached.select(F.explode(F.from_json("value", f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")).alias("r"), "load_ord").select("r.*", "load_ord")
        rows = keep_first(rows, ["entity_id"], "load_ord").join(self.records, "entity_id", "left_anti")
        return self.records.unionByName(_complete(rows), allowMissingColumns=True)

    def receive(self, answers: DataFrame, now: str | None = None) -> None:
        """Write answers (q, ord, record columns) back: as records that replace those of their ids and were loaded last,
        or in a key-value store as one list under each query, for the layer's ttl (without one, not at all)."""
        self.turns += 1
        last = F.lit(self.turns << 44)
        if self.kind != "redis":
            rows = keep_first(answers, ["entity_id"], "q", "ord").drop("q", "ord").withColumn("load_ord", last + F.col("load_ord"))
            self.records = cut(upsert(self.records, rows, True))
            self._keep(rows)
            return
        if not self.ttl:
            return
        at = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
        rec = F.struct(*[F.col(n) for n in ENTITY.fieldNames() if n in answers.columns])
        rows = answers.groupBy(F.col("q").alias("key")).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("ord", rec.alias("r")))), lambda x: x["r"])).alias("value"))
        rows = rows.select("key", "value", (at + F.make_dt_interval(secs=F.lit(self.ttl))).alias("expires_at"), last.cast("long").alias("load_ord"))
        self.cached = cut(rows if self.cached is None else self.cached.join(rows, "key", "left_anti").unionByName(rows))

    def load(self, new: DataFrame, overwrite: bool = False) -> int:
        """Load records; the count of those stored. A full-text or relational store keeps the fields of its mapping."""
        before = self.records
        if self.keys is not None:
            old = before.select("entity_id") if before is not None and not overwrite else None
            self._keep(upsert(None, new, overwrite) if old is None else upsert(None, new).join(old, "entity_id", "left_anti"))
        if self.field_mapping and self.kind in ("elasticsearch", "postgres"):
            new = map_fields(unmap_fields(new, self.field_mapping), self.field_mapping, self.kind)
        self.records = upsert(before, new, overwrite)
        if self.kind == "postgres":
            return new.count()
        stored = new.select("entity_id").distinct()
        if before is not None and not overwrite:
            stored = stored.join(before, "entity_id", "left_anti")
        return stored.count()

    def _keep(self, rows: DataFrame) -> None:
        """Records that are new or changed go to the stored index too."""
        if self.keys is not None:
            self.keys.write(_complete(rows))

    def clear(self) -> None:
        self.records, self.cached = self.records.limit(0) if self.records is not None else None, None

    def count(self) -> int:
        """Records; for a key-value store its keys, aliases included."""
        if self.records is None:
            return 0
        return self.key_values().select("key").distinct().count() if self.kind == "redis" else self.records.count()

    def set_embeddings(self, vectors: DataFrame, model_id: str) -> int:
        if self.records is None:
            return 0
        n = self.records.join(vectors, "entity_id", "left_semi")
        n = key_values(n).count() if self.kind == "redis" else n.count()  # a key-value store holds a record under each key
        self.records = cut(update_embeddings(self.records, vectors, model_id))
        return n


class Chain:
    """Layers by falling priority, those of equal priority as given."""

    def __init__(self, layers: list[Layer]):
        self.layers = sorted(layers, key=lambda x: -x.priority)

    def usable(self) -> list[Layer]:
        return [x for x in self.layers if x.available and x.records is not None]

    def load(self, source: DataFrame, target_layers: list[str] | None = None, overwrite: bool = False) -> dict[str, int]:
        """Into all layers that may be written, or into the named kinds or names, whether they may or not."""
        out = {}
        for x in self.layers:
            if x.records is None:  # an empty layer can be searched, and receive answers
                x.records = source.limit(0)
            wanted = x.write if target_layers is None else x.kind in target_layers or x.name in target_layers
            if x.available and wanted:
                out[x.kind] = x.load(source, overwrite)
        return out

    def get_layer(self, kind: str) -> Layer | None:
        """The first layer of a kind or name."""
        return next((x for x in self.layers if kind in (x.kind, x.name)), None)

    def clear(self) -> None:
        for x in self.layers:
            x.clear()

    def counts(self) -> dict[str, int]:
        return {x.kind: x.count() for x in self.layers if x.available}

    def all_entities(self) -> DataFrame:
        """Records of all layers, each id once, from the layer of highest priority."""
        rows = None
        for rank, x in enumerate(self.usable()):
            part = x.records.withColumn("layer_rank", F.lit(rank))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        if rows is None:
            raise ValueError("no layer has records")
        return keep_first(rows, ["entity_id"], "layer_rank", "load_ord")

    def precompute(self, encode, text: str, model_id: str, targets: list[str] | None = None) -> dict[str, int]:
        """Vectors of all records' formatted labels by `encode` (a function from a column of texts to vectors, such
        as a pandas UDF), each distinct text encoded once. Layers without a field of the template are passed over."""
        from ..schema import template, template_fields

        out = {}
        for x in self.usable():
            if targets is None or x.kind in targets:
                if any(f not in x.records.columns for f in template_fields(text)):
                    out[x.kind] = 0
                    continue
                lab = x.records.withColumn("_t", template(text, x.records.columns))
                vec = lab.select("_t").distinct().withColumn("embedding", encode(F.col("_t")))
                out[x.kind] = x.set_embeddings(lab.select("entity_id", "_t").join(vec, "_t").select("entity_id", "embedding"), model_id)
        return out

