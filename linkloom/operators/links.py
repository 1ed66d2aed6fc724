"""L3 and L4: candidate labels of texts, scorers that turn texts and labels into links, and the steps over links.

A scorer is a contract: (text, spans, labels) -> links with score and class_probs. lexical() compares names,
bi_encoder() vectors; model() plugs any Python model in through Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import similarity as S
from ..schema import LINKS, keep_first, norm, template


#: Keys over which texts are dealt when each gets the same list of labels.
SALTS = 64


def labels(candidates: DataFrame, text: str = "{label}") -> DataFrame:
    """(text_idx, label_text, entity_id, label_ord): formatted labels of each text's candidates, each once whatever
    its case, the first one standing."""
    c = candidates.withColumn("label_text", template(text, candidates.columns))
    first = keep_first(c, ["text_idx", F.lower("label_text")], "mention_idx", "cand_ord")
    order = Window.partitionBy("text_idx").orderBy("mention_idx", "cand_ord")
    about = F.col("description") if "description" in candidates.columns else F.lit(None).cast("string")
    return first.withColumn("label_ord", F.row_number().over(order)).select("text_idx", "label_text", "entity_id", "label", "aliases", about.alias("description"), "popularity", "embedding", "embedding_model_id", "label_ord")


def per_text(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates for a model that reads texts and labels together: those that all texts share are repeated for each, by
    a join in which every text has one of SALTS keys and the shared list is there once for each key."""
    if candidates.filter("text_idx is null").isEmpty():
        return candidates
    key = F.pmod(F.xxhash64("text_idx"), F.lit(SALTS))
    shared = candidates.filter("text_idx is null").drop("text_idx").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = texts.select("text_idx", key.cast("int").alias("_k")).join(shared, "_k").drop("_k")
    return candidates.filter("text_idx is not null").unionByName(each)


def precomputed_eligible(candidates: DataFrame, model_id: str) -> DataFrame:
    """(text_idx, eligible): texts all of whose candidates have a vector of the model."""
    ok = F.col("embedding").isNotNull() & F.coalesce(F.col("embedding_model_id") == model_id, F.lit(False))
    return candidates.groupBy("text_idx").agg(F.every(ok).alias("eligible"))


#: Labels of a text, and characters of it whose spans' vectors meet them, in one product.
LABELS, CHARS = 512, 512


def label_matrix(label_rows: DataFrame, most: int = LABELS) -> DataFrame:
    """(text_idx, part, labels, matrix): label_ord and label_text with the vectors in that order, `most` labels to a part;
    a label without a vector is an error."""
    v = F.when(F.col("embedding").isNull(), F.raise_error(F.concat(F.lit("no embedding for "), F.col("label_text")))).otherwise(F.col("embedding"))
    part = F.floor((F.col("label_ord") - 1) / most).alias("part")
    rows = label_rows.groupBy("text_idx", part).agg(F.sort_array(F.collect_list(F.struct("label_ord", "label_text", v.alias("v")))).alias("x"))
    return rows.select("text_idx", "part", F.transform("x", lambda x: F.struct(x["label_ord"].cast("int").alias("label_ord"), x["label_text"].alias("label_text"))).alias("labels"), F.transform("x", lambda x: x["v"]).alias("matrix"))


def missing_embeddings(candidates: DataFrame) -> DataFrame:
    """Candidates without a vector, each entity once: those that a cache write-back would give one."""
    return candidates.filter(F.col("embedding").isNull()).dropDuplicates(["entity_id"])


def spans(mentions: DataFrame) -> DataFrame:
    """(text_idx, spans): the mentions' spans as a scorer's constrained input."""
    return mentions.groupBy("text_idx").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _finish(pairs: DataFrame, threshold: float, multi_label: bool, flat: bool) -> DataFrame:
    """Pairs (text_idx, text, start, end, label_text, label_ord, score, maybe the label's chunk) to links: the best
    label of each span, in each chunk. Where pairs have a `z` (what the score is the logistic of), values that differ by
    less than the order of a sum can make them are ties, as equal scores are: the first label counts."""
    rank = F.round("z", 9) if "z" in pairs.columns else F.col("score")
    key = ["text_idx", "start", "end", *(["chunk"] if "chunk" in pairs.columns else [])]
    probs = pairs.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("label_text", "score")))).alias("class_probs"))
    best = pairs.filter(F.col("score") >= threshold)
    if not multi_label:
        best = keep_first(best, key, rank.desc(), "label_ord")
    out = best.join(probs, key)
    out = out.withColumn("link_ord", F.row_number().over(Window.partitionBy("text_idx").orderBy("start", rank.desc(), "end", "label_ord")).cast("long"))
    out = out.select("text_idx", "link_ord", "text", F.col("label_text").alias("label"), "start", "end", "score", "class_probs")
    return flat_spans(out) if flat else out


def lexical(mentions: DataFrame, label_rows: DataFrame, threshold: float = 0.5, multi_label: bool = False, flat: bool = True, max_labels: int | None = None) -> DataFrame:
    """Score of a span for a label: the best edit similarity with its entity's label or aliases. With max_labels a
    text's labels are scored in chunks of so many, each chunk by itself: a span may get a link from each."""
    m = mentions.select("text_idx", "text", "start", "end").withColumn("q", norm(F.col("text")))
    pairs = m.join(label_rows, "text_idx")
    names = pairs.select("q", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"), "label", "entity_id")
    names = names.withColumn("n", F.lower("n")).select("q", "n", "entity_id").distinct().withColumn("s", S.indel_ratio(F.col("q"), F.col("n")))
    sim = names.groupBy("q", "entity_id").agg(F.max("s").alias("score"))
    chunk = F.floor((F.col("label_ord") - 1) / max_labels) if max_labels else F.lit(0)
    scored = pairs.join(sim, ["q", "entity_id"]).select("text_idx", "text", "start", "end", "label_text", "label_ord", "score", chunk.cast("long").alias("chunk"))
    return _finish(scored, threshold, multi_label, flat)


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def bi_encoder(mentions: DataFrame, label_rows: DataFrame, threshold: float = 0.5, multi_label: bool = False, flat: bool = True) -> DataFrame:
    """Score sigmoid(span vector . label vector); mentions carry a column `vector` (without one they have no links).
    The spans of a stretch of a text and its labels are one row, and one product of matrices: vectors are not copied
    into pairs."""
    m = mentions.filter(F.col("vector").isNotNull()).groupBy("text_idx", F.floor(F.col("start") / CHARS).alias("stretch")).agg(
        F.collect_list(F.struct("text", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("vector").cast("array<float>").alias("vector"))).alias("spans"))
    both = m.join(label_matrix(label_rows), "text_idx").select(F.col("text_idx").cast("long"), "spans", "labels", "matrix")

    def score(batches):
        held, n = [], 0
        for b in batches:
            for i in range(b.num_rows):
                if n > 1 << 16:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, n = [], 0
                spans, labels = b.column(1)[i].values, b.column(2)[i].values
                z = _matrix(spans.field("vector")) @ _matrix(b.column(3)[i].values).T
                at, of = (pa.array(x.ravel()) for x in np.indices(z.shape))
                n += z.size
                held.append(pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(z.size, i))), *[spans.field(c).take(at) for c in ("text", "start", "end")], *[labels.field(c).take(of) for c in ("label_text", "label_ord")], pa.array(1 / (1 + np.exp(-z.ravel())))],
                                                       names=["text_idx", "text", "start", "end", "label_text", "label_ord", "score"]))
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    pairs = both.mapInArrow(score, "text_idx long, text string, start int, end int, label_text string, label_ord int, score double")
    return _finish(pairs, threshold, multi_label, flat)


def model(texts: DataFrame, label_rows: DataFrame, load: Callable[[], Callable[[str, list[str], list | None], Iterable[dict]]], threshold: float = 0.5, span_rows: DataFrame | None = None, max_labels: int | None = None) -> DataFrame:
    """Any model: load() makes, once per worker, a function (text, labels, spans) -> dicts with text, label, start,
    end, score and class_probs. One row per text, or per chunk of max_labels labels. No labels, no links."""
    rows = chunks(label_rows, max_labels).join(texts, "text_idx")
    rows = rows.join(span_rows, "text_idx", "left") if span_rows is not None else rows.withColumn("spans", F.lit(None).cast("array<struct<start:int,end:int>>"))

    def run(it):
        predict = load()
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                got = predict(r.text, list(r.labels), None if r.spans is None else [dict(s) for s in r.spans])
                for k, e in enumerate(got):
                    if e["score"] >= threshold:
                        out.append((r.text_idx, (int(r.chunk) << 32) + k, e["text"], e["label"], e["start"], e["end"], float(e["score"]), e.get("class_probs")))
            yield pd.DataFrame(out, columns=LINKS.names)

    return rows.select("text_idx", "text", "labels", "chunk", "spans").mapInPandas(run, LINKS)


def encode_labels(label_rows: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
    """label_rows with vectors made on the fly, each distinct label encoded once."""
    vec = label_rows.select("label_text").distinct().withColumn("embedding", encode(F.col("label_text")).cast("array<float>"))
    return label_rows.drop("embedding").join(vec, "label_text")


def bi_encoder_links(mentions: DataFrame, candidates: DataFrame, label_rows: DataFrame, model_id: str, encode: Callable[[Column], Column] | None, precomputed: bool = True, **settings) -> DataFrame:
    """bi_encoder() with the candidates' own vectors for texts all of whose candidates have one of the model; other
    texts' labels are encoded on the fly, or, without an encoder, give no links."""
    ready = precomputed_eligible(candidates, model_id).filter("eligible").select("text_idx") if precomputed else candidates.select("text_idx").limit(0)
    rows = label_rows.join(ready, "text_idx", "left_semi").select(label_rows.columns)
    if encode is not None:
        rows = rows.unionByName(encode_labels(label_rows.join(ready, "text_idx", "left_anti"), encode).select(label_rows.columns))
    return bi_encoder(mentions, rows, **settings)


def shared_links(texts: DataFrame, candidates: DataFrame, text: str = "{label}", threshold: float = 0.5, multi_label: bool = False, flat: bool = True) -> DataFrame:
    """Links for candidates that all texts share (a null text_idx): one table of labels for all of them. Spans are
    where a candidate's label or alias stands in the text, and score 1. A span has one link, to the first candidate
    of that name, or with multi_label one to each; with flat no two links overlap, the longer one of those that
    begin first staying."""
    from .gazetteer import gazetteer_mentions

    c = candidates.withColumn("label_text", template(text, candidates.columns))
    names = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    forms = c.select("cand_ord", "label_text", F.explode(F.transform(names, lambda x: norm(x))).alias("key"))
    forms = keep_first(forms, ["key", "label_text"] if multi_label else ["key"], "cand_ord")
    found = gazetteer_mentions(texts, forms.select("key")).withColumn("key", F.lower("text"))
    got = found.join(forms, "key").withColumn("score", F.lit(1.0)).filter(F.col("score") >= threshold)
    probs = F.map_from_entries(F.sort_array(F.collect_set(F.struct("label_text", "score")).over(Window.partitionBy("text_idx", "start", "end"))))
    order = Window.partitionBy("text_idx").orderBy("start", "end", "cand_ord", "label_text")
    got = got.withColumn("link_ord", F.row_number().over(order).cast("long")).withColumn("class_probs", probs)
    got = got.select("text_idx", "link_ord", "text", F.col("label_text").alias("label"), "start", "end", "score", "class_probs")
    return flat_spans(got) if flat else got


def chunks(label_rows: DataFrame, max_labels: int | None = None) -> DataFrame:
    """(text_idx, chunk, labels): labels in order, max_labels to a chunk."""
    c = F.floor((F.col("label_ord") - 1) / max_labels) if max_labels else F.lit(0)
    return label_rows.groupBy("text_idx", c.cast("int").alias("chunk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("label_ord", "label_text"))), lambda x: x["label_text"]).alias("labels"))


def filter_by_score(links: DataFrame, threshold: float = 0.5) -> DataFrame:
    return links.filter(F.col("score") >= threshold)


def sort_by_position(links: DataFrame) -> DataFrame:
    """link_ord follows the starts, ties as they were."""
    return links.withColumn("link_ord", F.row_number().over(Window.partitionBy("text_idx").orderBy("start", "link_ord")).cast("long"))


def deduplicate_links(links: DataFrame) -> DataFrame:
    """The first link of each text and span."""
    return keep_first(links, ["text_idx", "text", "start", "end"], "link_ord")


def deduplicate_best(links: DataFrame) -> DataFrame:
    """The best-scored link of each text and span, where the first one stood."""
    key = ["text_idx", "text", "start", "end"]
    first = links.groupBy(*key).agg(F.min("link_ord").alias("_first"))
    return keep_first(links, key, F.col("score").desc(), "link_ord").join(first, key).withColumn("link_ord", F.col("_first")).drop("_first").select(links.columns)


def flat_spans(links: DataFrame) -> DataFrame:
    """Greedy links without overlaps: best score first, then the first start, then the longest. A text's spans fall into islands that don't touch; the links of
    one island are folded in one native expression."""
    before = Window.partitionBy("text_idx").orderBy("start", "end", "link_ord").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("text_idx").orderBy("start", "end", "link_ord").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.coalesce((F.col("start") >= F.max("end").over(before)).cast("int"), F.lit(1))
    rows = links.select("text_idx", "start", "end", "link_ord", "score").withColumn("_b", begins).withColumn("island", F.sum("_b").over(so_far))
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "start", (-F.col("end")).alias("long"), "end", "link_ord")))

    def add(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda y: ~((y["end"] <= x["start"]) | (y["start"] >= x["end"])) & ~((y["start"] == x["start"]) & (y["end"] == x["end"])))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    kept = rows.groupBy("text_idx", "island").agg(best.alias("xs")).withColumn("xs", F.aggregate("xs", F.slice("xs", 1, 0), add))
    ids = kept.select("text_idx", F.explode("xs.link_ord").alias("link_ord"))
    return links.join(ids, ["text_idx", "link_ord"], "left_semi").select(links.columns)


def rank(links: DataFrame, candidates: DataFrame, weights: list[tuple[str, float]], shared: bool = False) -> DataFrame:
    """Scores as weighted averages of features: gliner_score is the link's own score, others numbers of the
    candidate whose bare label (else alias) is the link's label, over a million and at most 1; what is missing
    counts as 0. No weight at all changes nothing. link_ord follows the new scores. `shared`: the candidates (a null
    text_idx) are every text's."""
    total = sum(w for _, w in weights)
    if not total:
        return links
    for f, _ in weights:
        if f in candidates.columns and not isinstance(candidates.schema[f].dataType, NumericType):
            raise ValueError(f"rank field {f!r} is not a number")
    key = ["label"] if shared else ["text_idx", "label"]
    own = [] if shared else [F.col("text_idx")]
    fields = [f for f, _ in weights if f != "gliner_score" and f in candidates.columns]
    forms = candidates.select(*own, F.col("label").alias("label"), F.lit(0).alias("k"), (-F.col("mention_idx")).alias("o1"), (-F.col("cand_ord")).alias("o2"), *[F.col(f).alias(f"_{f}") for f in fields])
    alias = candidates.select(*own, F.explode("aliases").alias("label"), F.lit(1).alias("k"), F.col("mention_idx").alias("o1"), F.col("cand_ord").alias("o2"), *[F.col(f).alias(f"_{f}") for f in fields])
    forms = keep_first(forms.unionByName(alias), key, "k", "o1", "o2").drop("k", "o1", "o2")
    got = links.join(forms, key, "left")
    s = F.lit(0.0)
    for f, w in weights:
        if f == "gliner_score":
            s = s + F.lit(w) * F.col("score")
        elif f in fields:
            s = s + F.lit(w) * F.least(F.coalesce(F.col(f"_{f}"), F.lit(0)) / 1e6, F.lit(1.0))
    got = got.withColumn("score", s / total)
    w = Window.partitionBy("text_idx").orderBy(F.col("score").desc(), "link_ord")
    return got.withColumn("link_ord", F.row_number().over(w).cast("long")).select(links.columns)


METHODS = {"filter_by_score": filter_by_score, "sort_by_position": sort_by_position, "deduplicate_entities": deduplicate_links, "deduplicate_best": deduplicate_best, "flat_spans": flat_spans}
