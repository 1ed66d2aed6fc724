"""The processors of the five layers. Each is a lazy step from DataFrames to a DataFrame; what several later steps
read is written once (session.cut)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, candidates, gazetteer, links, mentions, scorer, tagger
from ..schema import MENTIONS, template
from ..session import cut
from ..sources import kb, stores
from .registry import Steps, register

#: Scorers and encoders that configs may name besides the lexical one.
MODELS: dict[str, Any] = {}
#: Encoders of labels (a column of texts to a column of vectors) by model name.
ENCODERS: dict[str, Any] = {}
#: Trained taggers (operators.tagger.train) by model name.
TAGGERS: dict[str, Any] = {}
#: Weights of context scorers (operators.scorer.train) by model name.
SCORERS: dict[str, Any] = {}


def _steps(config: dict, methods: dict, default: list) -> Steps:
    return Steps(methods, [tuple(x) for x in config.get("pipeline", default)])


class Processor:
    #: The knowledge base of the pipeline's L2, which the executor sets.
    chain: kb.Chain | None = None

    def __init__(self, config: dict, spark: SparkSession):
        self.config, self.spark, self.schema = config, spark, {}

    @property
    def template(self) -> str:
        return self.schema.get("template", "{label}")


class Extract(Processor):
    """L1: a registered model, a trained tagger, a pattern, or the surface forms of the pipeline's knowledge base."""

    def __init__(self, config, spark):
        super().__init__(config, spark)
        self.steps = _steps(config, mentions.METHODS, [("filter_by_length", {"min_length": config.get("min_entity_length", 2)}), *mentions.DEFAULT])

    def _model(self):
        """The registered model: it finds (start, end, label) or with a score; labels and threshold of the config
        choose among them."""
        find, labels, least = MODELS[self.config["model"]], set(self.config.get("labels") or ()), self.config.get("threshold", 0.0)

        def chosen(text: str):
            for start, end, label, *score in find(text):
                if (not labels or label in labels) and (not score or score[0] >= least):
                    yield start, end, label

        return chosen

    def __call__(self, texts: DataFrame, surfaces: DataFrame | None = None, **_) -> DataFrame:
        c = self.config
        left, right = c.get("max_left_context", 50), c.get("max_right_context", 50)
        if surfaces is None and not c.get("pattern") and self.chain is not None and self.chain.usable():
            surfaces = kb.surface_forms(self.chain.all_entities())
        if c.get("model") in MODELS:
            got = mentions.extract(texts, self._model(), left, right)
        elif c.get("model") in TAGGERS:
            got = tagger.tag(texts, TAGGERS[c["model"]], c.get("labels"), left, right)
        elif surfaces is not None and not c.get("pattern"):
            got = gazetteer.gazetteer_mentions(texts, surfaces, left, right)
        else:
            got = mentions.pattern_mentions(texts, c.get("pattern", r"\p{Lu}\p{L}{3,}"), c.get("label"), left, right)
        return self.steps(got)


@register("l1_spacy")
def l1_tokens(config, spark):
    return Extract(config, spark)


@register("l1_gliner")
def l1_model(config, spark):
    return Extract(config, spark)


@register("l2_chain")
class Candidates(Processor):
    def __init__(self, config, spark):
        super().__init__(config, spark)
        self.chain = kb.Chain([_layer(x, spark) for x in config.get("layers", [{"type": "dict", "fuzzy": {"min_similarity": 0.6}, "search_mode": ["exact", "fuzzy"]}])])
        self.steps = [tuple(x) for x in config["pipeline"] if x[0] != "search"] if config.get("pipeline") else None
        Steps(candidates.METHODS, self.steps or [])  # unknown methods are an error here, not when data runs

    def __call__(self, texts: DataFrame | None = None, mentions: DataFrame | list | None = None, structure: list | None = None, **_) -> DataFrame:
        """Candidates of mentions (rows, or a flat list of texts with maybe a structure); without mentions all records,
        which all texts share. Answers go back to the layers above the one that gave them."""
        c = self.config
        if mentions is None:
            return candidates.all_entities(self.chain.all_entities()).withColumn("hit_layer", F.lit("all"))
        if isinstance(mentions, list):
            mentions = candidates.flat_mentions(self.spark, mentions, structure)
        return candidates.candidates(mentions, self.chain, c.get("max_candidates", 30), c.get("min_popularity", 0), self.steps, cache=True)


def _layer(x: dict, spark: SparkSession) -> kb.Layer:
    out = kb.Layer(x.get("name", x.get("type", "dict")), x.get("type", "dict"), x.get("priority", 0), x.get("write", True), list(x.get("search_mode", ["exact"])), x.get("ttl", 0), x.get("cache_policy", "always"),
                   dict(x.get("field_mapping") or {}), dict(x.get("fuzzy") or {}), config=dict(x.get("config") or {}))
    stores.connect(spark, out)
    return out


class Link(Processor):
    """L3, or L4 where labels come in chunks. A registered model scores texts and labels; mentions with a `vector` and
    a registered encoder (or candidates with vectors of model_name) are scored by a bi-encoder, those of a pipeline
    whose model_name has trained weights by their context; else edit similarity with labels and aliases is the score. Candidates that all texts share are found in the texts by their names."""

    chunked = False

    def __init__(self, config, spark):
        super().__init__(config, spark)
        tail = [("deduplicate_best", {})] if self.chunked else []
        self.steps = _steps(config, links.METHODS, tail + [("filter_by_score", {"threshold": config.get("threshold", 0.5)}), ("sort_by_position", {})])

    def __call__(self, texts: DataFrame, candidates: DataFrame, mentions: DataFrame | None = None, **_) -> DataFrame:
        c = self.config
        name, low = c.get("model_name"), c.get("threshold", 0.5)
        shape = {"threshold": low, "multi_label": c.get("multi_label", False), "flat": c.get("flat_ner", True)}
        if mentions is None and name not in MODELS:
            out = links.shared_links(texts, candidates, self.template, **shape)
        else:
            rows = cut(links.labels(links.per_text(candidates, texts), self.template))
            if mentions is not None and "vector" in mentions.columns and (name in ENCODERS or c.get("use_precomputed_embeddings")):
                out = links.bi_encoder_links(mentions, candidates, rows, name, ENCODERS.get(name), c.get("use_precomputed_embeddings", False), **shape)
                self._cache(candidates)
            elif mentions is not None and name in SCORERS:
                out = scorer.context_links(mentions, rows, SCORERS[name], **shape, max_labels=c.get("max_labels") if self.chunked else None)
            elif name in MODELS:
                given = links.spans(mentions) if mentions is not None and c.get("use_spans", True) else None
                out = links.model(texts, rows, MODELS[name], low, given, c.get("max_labels") if self.chunked else None)
            else:
                out = links.lexical(mentions, rows, **shape, max_labels=c.get("max_labels") if self.chunked else None)
        out = self.steps(out)
        ranking = self.schema.get("ranking")
        return links.rank(out, candidates, [(r["field"], r["weight"]) for r in ranking], shared=mentions is None) if ranking else out

    @property
    def supports_precomputed_embeddings(self) -> bool:
        """Can the model score labels by vectors?"""
        return self.config.get("model_name") in ENCODERS

    def _cache(self, candidates: DataFrame) -> None:
        """Vectors of candidates that have none go to the first layer that answers."""
        encode = ENCODERS.get(self.config.get("model_name"))
        if not self.config.get("cache_embeddings") or encode is None or self.chain is None or not self.chain.usable():
            return
        rows = links.missing_embeddings(candidates)
        rows = rows.withColumn("label_text", template(self.template, rows.columns)).select("entity_id", "label_text")
        self.chain.usable()[0].set_embeddings(cut(links.encode_labels(rows, encode)), self.config["model_name"])


@register("l3_batch")
def l3_batch(config, spark):
    return Link(config, spark)


@register("l4_reranker")
def l4_reranker(config, spark):
    out = type("Rerank", (Link,), {"chunked": True})(config, spark)
    return out


@register("l0_aggregator")
class Aggregate(Processor):
    def __init__(self, config, spark):
        super().__init__(config, spark)
        default = [("filter_by_confidence", {"min_confidence": config.get("min_confidence", 0.0), "include_unlinked": config.get("include_unlinked", True)}), ("sort_by_confidence", {})]
        self.steps = _steps(config, aggregate.METHODS, default)

    def __call__(self, mentions: DataFrame | None = None, candidates: DataFrame | None = None, links: DataFrame | None = None, **_) -> DataFrame:
        """Without mentions (texts alone are given) only links without a mention are left, in loose mode."""
        if candidates is None or links is None:
            raise ValueError("candidates and links are needed")
        c = self.config
        if mentions is None:
            mentions = self.spark.createDataFrame([], MENTIONS)
        candidates = aggregate.of_links(candidates, links, self.template)
        rows = aggregate.aggregate(mentions, candidates, links, self.template, c.get("position_tolerance", 2), c.get("strict_matching", True))
        return self.steps(rows)

    @staticmethod
    def stats(rows: DataFrame) -> DataFrame:
        return aggregate.calculate_stats(rows) if "is_linked" in rows.columns else rows
