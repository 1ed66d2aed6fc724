"""Pipelines from code, dicts, YAML, or a few arguments."""

from __future__ import annotations

from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import SparkSession

from .dag import Executor

#: Default thresholds of edit similarity: of a layer that is added, of the one made when none is, and of other stores.
FUZZY_ADDED, FUZZY_AUTO, FUZZY_STORE = 0.75, 0.6, 0.3

# The settings of each layer's config and their defaults.
_CONTEXT = {"max_right_context": 50, "max_left_context": 50, "min_entity_length": 2}
L1_TOKENS = {"model": "", "device": "cpu", "batch_size": 32, **_CONTEXT, "include_noun_chunks": False, "pattern": None}
L1_MODEL = {"model": "", "labels": (), "token": None, "device": "cpu", "threshold": 0.3, "flat_ner": True, "multi_label": False, "batch_size": 16, **_CONTEXT, "use_precomputed_embeddings": False, "max_length": 512}
L3 = {"model_name": "", "huggingface_token": None, "device": "cpu", "threshold": 0.5, "flat_ner": True, "multi_label": False, "batch_size": 1, "use_precomputed_embeddings": False, "cache_embeddings": False, "max_length": 512}
L4 = {"model_name": "", "token": None, "device": "cpu", "threshold": 0.5, "flat_ner": True, "multi_label": False, "max_labels": 20, "max_length": 512}
L0 = {"min_confidence": 0.0, "include_unlinked": True, "return_all_candidates": False, "strict_matching": True, "position_tolerance": 2}
TTL = {"redis": 3600, "elasticsearch": 86400}
STORES = {
    "redis": {"host": "localhost", "port": 6379, "db": 0},
    "elasticsearch": {"hosts": ["http://localhost:9200"], "index_name": "entities"},
    "postgres": {"host": "localhost", "port": 5432, "database": "entities_db", "user": "postgres", "password": "postgres"},
}
FIELDS = ["entity_id", "label", "aliases", "description", "entity_type", "popularity"]
VECTORS = ["embedding", "embedding_model_id"]


class _Settings:
    """The settings of one layer: configure() (or a call) takes some, the others have their defaults."""

    def __init__(self, owner: ConfigBuilder, defaults: dict, names: dict[str, str] | None = None):
        self.owner, self.defaults, self.names, self.values = owner, defaults, names or {}, None

    def configure(self, *args: Any, **kw: Any) -> ConfigBuilder:
        given = dict(zip(self.defaults, args)) | {self.names.get(k, k): v for k, v in kw.items()}
        unknown = set(given) - set(self.defaults)
        if unknown:
            raise TypeError(f"unknown settings {sorted(unknown)}; there are {sorted(self.defaults)}")
        self.values = {k: list(v) if isinstance(v, tuple) else v for k, v in (self.defaults | given).items()}
        return self.owner

    __call__ = configure


class _Mentions:
    """L1: mentions from the knowledge base's names or a pattern, or from a registered model."""

    def __init__(self, owner: ConfigBuilder):
        self.owner, self.kind, self.values = owner, None, None
        self._of = {"l1_spacy": _Settings(owner, L1_TOKENS), "l1_gliner": _Settings(owner, L1_MODEL)}

    def _set(self, kind: str, args: tuple, kw: dict) -> ConfigBuilder:
        out = self._of[kind].configure(*args, **kw)
        self.kind, self.values = kind, {k: v for k, v in self._of[kind].values.items() if v is not None}
        return out

    def spacy(self, *args: Any, **kw: Any) -> ConfigBuilder:
        return self._set("l1_spacy", args, kw)

    def gliner(self, *args: Any, **kw: Any) -> ConfigBuilder:
        return self._set("l1_gliner", args, kw)


class _Layers:
    def __init__(self, owner: ConfigBuilder):
        self.owner, self.items, self.options, self.vectors = owner, [], {}, None

    def add(self, kind: str, priority: int = 0, write: bool | None = None, search_mode: list[str] | None = None, ttl: int | None = None, cache_policy: str | None = None, fuzzy_similarity: float | None = None,
            fuzzy: dict | None = None, field_mapping: dict | None = None, **db_config: Any) -> ConfigBuilder:
        """A layer. What is not given depends on its kind: a relational store isn't written, a key-value store is
        searched exactly, caches expire, a full-text store caches what it misses."""
        if kind not in ("dict", *STORES):
            raise ValueError(f"unknown layer type {kind!r}")
        item = {"type": kind, "priority": priority, "write": kind != "postgres" if write is None else write,
                "search_mode": search_mode or (["exact"] if kind == "redis" else ["exact", "fuzzy"]), "ttl": TTL.get(kind, 0) if ttl is None else ttl,
                "cache_policy": cache_policy or ("miss" if kind == "elasticsearch" else "always"), "field_mapping": field_mapping or self._mapping()}
        if kind == "dict":
            item["fuzzy"] = {"max_distance": 64, "min_similarity": FUZZY_ADDED if fuzzy_similarity is None else fuzzy_similarity, "n_gram_size": 3, "prefix_length": 1} | (fuzzy or {})
        elif kind != "redis":
            item["fuzzy"] = {"min_similarity": FUZZY_STORE if fuzzy_similarity is None else fuzzy_similarity} | (fuzzy or {})
        if kind in STORES:
            item["config"] = STORES[kind] | db_config
        self.items.append(item)
        return self.owner

    def _mapping(self) -> dict[str, str]:
        return {f: f for f in FIELDS + (VECTORS if self.vectors else [])}

    def configure(self, max_candidates: int | None = None, min_popularity: int = 0) -> ConfigBuilder:
        self.options = {"min_popularity": min_popularity} | ({} if max_candidates is None else {"max_candidates": max_candidates})
        return self.owner

    def embeddings(self, enabled: bool = True, model_name: str = "", dim: int = 768, precompute_on_load: bool = False) -> ConfigBuilder:
        self.vectors = {"enabled": enabled, "model_name": model_name, "dim": dim, "precompute_on_load": precompute_on_load}
        for x in self.items:
            x["field_mapping"] |= {f: f for f in VECTORS}
        return self.owner

    def map_fields(self, **mapping: str) -> ConfigBuilder:
        self.items[-1]["field_mapping"] = mapping
        return self.owner

    def build(self) -> dict:
        if not self.items:
            self.add("dict", fuzzy_similarity=FUZZY_AUTO)
        return {"max_candidates": 10 if self.vectors else 5, "min_popularity": 0} | self.options | {"layers": self.items} | ({"embeddings": self.vectors} if self.vectors else {})


class ConfigBuilder:
    """Fluent construction; build() gives the whole config as a dict. Without l1, mentions come from the input."""

    def __init__(self, name: str = "pipeline", description: str | None = None):
        self.name, self.description = name, description or f"{name} - auto-generated configuration"
        self.l1, self.l2 = _Mentions(self), _Layers(self)
        self.l3, self.l4 = _Settings(self, L3, {"model": "model_name", "token": "huggingface_token"}), _Settings(self, L4, {"model": "model_name"})
        self.l0 = _Settings(self, L0)
        self.l0.configure()
        self._template, self._ranking = "{label}: {description}", None

    def set_schema_template(self, template: str) -> ConfigBuilder:
        self._template = template
        return self

    def set_ranking(self, ranking: list[dict]) -> ConfigBuilder:
        self._ranking = ranking
        return self

    def build(self) -> dict:
        if self.l3.values is None and self.l4.values is None:
            raise ValueError("a linking layer is needed: call l3.configure() or l4.configure()")
        schema = {"template": self._template} | ({"ranking": self._ranking} if self._ranking else {})
        texts, nodes, before = {"source": "$input", "fields": "texts"}, [], []
        spans = {"source": "l1_result"} if self.l1.kind else {"source": "$input", "fields": "entities"}
        if self.l1.kind:
            nodes.append({"id": "l1", "processor": self.l1.kind, "inputs": {"texts": texts}, "output": {"key": "l1_result"}, "config": self.l1.values})
            before = ["l1"]
        nodes.append({"id": "l2", "processor": "l2_chain", "requires": list(before), "inputs": {"texts": texts, "mentions": spans}, "output": {"key": "l2_result"}, "config": self.l2.build(), "schema": schema})
        before.append("l2")
        last = None
        for i, name, part in (("l3", "l3_batch", self.l3), ("l4", "l4_reranker", self.l4)):
            if part.values is not None:
                nodes.append({"id": i, "processor": name, "requires": list(before), "inputs": {"texts": texts, "candidates": {"source": "l2_result"}, "mentions": spans}, "output": {"key": f"{i}_result"}, "config": part.values, "schema": schema})
                before.append(i)
                last = f"{i}_result"
        nodes.append({"id": "l0", "processor": "l0_aggregator", "requires": before, "inputs": {"mentions": spans, "candidates": {"source": "l2_result"}, "links": {"source": last}}, "output": {"key": "l0_result"}, "config": self.l0.values, "schema": schema})
        return {"name": self.name, "description": self.description, "nodes": nodes}

    get_config = build

    def save(self, filepath: str) -> None:
        p = Path(filepath)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(yaml.safe_dump(self.build(), sort_keys=False, allow_unicode=True))


def load_yaml(path: str) -> dict:
    return yaml.safe_load(Path(path).read_text())


class Factory:
    @staticmethod
    def create_pipeline(path: str, spark: SparkSession) -> Executor:
        return Executor(load_yaml(path), spark)

    @staticmethod
    def create_from_dict(config: dict, spark: SparkSession) -> Executor:
        return Executor(config, spark)

    @staticmethod
    def create_simple(spark: SparkSession, model_name: str = "", threshold: float = 0.5, template: str = "{label}", entities: Any = None, reranker: bool = False, max_labels: int = 20,
                      external_entities: bool = False, pattern: str | None = None, **l0: Any) -> Executor:
        """L2 to L0 over one dict layer. Mentions are given with the input (external_entities) or found by a pattern;
        without either every text has all entities as its candidates. reranker puts L4 in L3's place."""
        b = ConfigBuilder("simple").set_schema_template(template)
        b.l0.configure(**({"strict_matching": False} if not external_entities and not pattern else {}) | l0)
        b = b.l4.configure(model=model_name, threshold=threshold, max_labels=max_labels) if reranker else b.l3.configure(model=model_name, threshold=threshold)
        if pattern:
            b.l1.spacy(pattern=pattern)
        b.l2.add("dict", fuzzy_similarity=FUZZY_AUTO)
        out = Executor(b.build(), spark)
        if entities is not None:
            out.load_entities(entities)
        return out
