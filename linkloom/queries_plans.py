"""Queries over plans, stores and registered parts: context and inputs, layers and write-back, models by name."""

from __future__ import annotations

import re
import uuid
from types import SimpleNamespace

from pyspark.sql import functions as F

from .operators import aggregate as A
from .operators import candidates as C
from .operators import links as L
from .operators import mentions as M
from .operators import tagger
from .plans import dag, processors, registry
from .queries import AGG, LINE, MEN, _lines, _linked, _mentions, _part_candidates, _talks, _texts, names_kb, part_kb, query
from .session import cut, shared_folder
from .sources import kb, stored


# --- records and layers -----------------------------------------------------------------------

@query("SELECT CAST(n_nationkey AS VARCHAR) AS entity_id, n_name AS label, 1 AS n_aliases FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'key' || CAST(n_nationkey AS VARCHAR), n_name, 0 FROM nation WHERE n_nationkey % 2 = 1")
def kb_from_lists_and_mappings(t):
    """Records given as dicts, objects, and a dict of dicts whose key stands in for a missing id."""
    rows = [(r["n_nationkey"], r["n_name"]) for r in t("nation").collect()]  # a dimension of fixed size
    spark = t("nation").sparkSession
    even = [dict(entity_id=str(k), label=n, aliases=[n.lower()]) for k, n in rows if k % 2 == 0]
    odd = {f"key{k}": {"label": n} for k, n in rows if k % 2}
    given = [e if i % 2 else SimpleNamespace(**e) for i, e in enumerate(even)]
    got = kb.load_source(spark, given).unionByName(kb.load_source(spark, odd))
    return got.select("entity_id", "label", F.size("aliases").alias("n_aliases"))


@query("WITH n AS (SELECT count(*) AS n FROM part) SELECT 'open' AS layer, n AS records FROM n UNION ALL SELECT 'frozen', n FROM n UNION ALL SELECT 'down', 0")
def kb_target_layers(t):
    """Layers that may be written are loaded by default; a named one even if it may not; one that is down never."""
    down = kb.Layer("down", "postgres", 0, available=False)
    chain = kb.Chain([kb.Layer("open", "dict", 2), kb.Layer("frozen", "elasticsearch", 1, write=False), down])
    chain.load(part_kb(t))
    chain.load(part_kb(t), ["frozen"])
    out = None
    for x in chain.layers:
        rows = x.records.agg(F.count("*").alias("records")).select(F.lit(x.name).alias("layer"), "records")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT CAST(p_partkey AS VARCHAR) AS entity_id, p_name AS label FROM part WHERE p_partkey % 3 = 0")
def kb_cleared(t):
    """A layer that was cleared holds what was loaded since."""
    x = kb.Layer("a")
    x.load(part_kb(t))
    kb.Chain([x]).clear()
    x.load(part_kb(t).filter("load_ord % 3 = 0"))
    return x.records.select("entity_id", "label")


@query("SELECT CAST(p_partkey AS VARCHAR) AS entity_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS label FROM part")
def kb_store_upsert(t):
    """A relational store: a load keeps the rows that are there, one that overwrites takes their place."""
    x = kb.Layer("rel", "postgres")
    x.load(part_kb(t))
    x.load(part_kb(t).withColumn("label", F.lit("kept out")))
    x.load(part_kb(t).filter("load_ord % 2 = 0").withColumn("label", F.element_at(F.split(F.col("aliases")[0], " (?=Brand)"), -1)), True)
    return x.records.select("entity_id", "label")


@query("SELECT CAST(p_partkey AS VARCHAR) AS entity_id, p_name AS label, 2 AS n_keys FROM part")
def kb_scan_key_values(t):
    """All records of a key-value store, each once, from the values under its keys."""
    v = kb.key_values(kb._complete(part_kb(t))).select("key", F.get_json_object("value", "$.entity_id").alias("entity_id"), F.get_json_object("value", "$.label").alias("label"))
    return v.groupBy("entity_id", "label").agg(F.count("*").cast("int").alias("n_keys"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS title, CAST(p_size AS BIGINT) AS rank FROM part")
def kb_reverse_mapping(t):
    """Records as rows of a store that has other names for their fields."""
    return kb.unmap_fields(kb._complete(part_kb(t)), {"entity_id": "code", "label": "title", "popularity": "rank"}).drop("load_ord")


@query("SELECT CAST(p_partkey AS VARCHAR) AS entity_id, CASE WHEN p_size % 2 = 0 THEN 1.0::DOUBLE END AS v1 FROM part")
def kb_precompute_passes_over(t):
    """A layer without a field of the template gets no vectors, another one does."""
    rows = kb._complete(part_kb(t))
    even, odd = kb.Layer("even", records=rows.filter("popularity % 2 = 0")), kb.Layer("odd", "postgres", records=rows.filter("popularity % 2 = 1").drop("description"))
    kb.Chain([even, odd]).precompute(lambda c: F.array(F.lit(1.0).cast("float")), "{label}: {description}", "m")
    both = even.records.unionByName(odd.records, allowMissingColumns=True)
    return both.select("entity_id", F.col("embedding")[0].cast("double").alias("v1"))


def _asked(t, kind: str) -> kb.Layer:
    """The upper of two layers after the lower one has answered for all part names."""
    chain = kb.Chain([kb.Layer("up", kind, 2, True, ["exact"], 3600), kb.Layer("down", "dict", 1, False, ["exact"])])
    chain.load(kb._complete(names_kb(t)), ["down"])
    m = t("part").select(F.col("p_partkey").alias("text_idx"), F.lit(0).cast("long").alias("mention_idx"), F.col("p_name").alias("text"))
    C.candidates(m, chain, 5, 0, cache=True)
    return chain.get_layer("up")


@query("SELECT lower(p_name) AS key, CAST(min(p_partkey) AS VARCHAR) AS entity_id, 1 AS n, true AS lasts FROM part GROUP BY lower(p_name)")
def write_back_key_value(t):
    """Answers in a key-value store: one list under each query, for an hour."""
    v = _asked(t, "redis").cached
    ids = F.from_json("value", "array<struct<entity_id:string>>")["entity_id"]
    return v.select("key", ids[0].alias("entity_id"), F.size(ids).alias("n"), (F.col("expires_at") > F.current_timestamp()).alias("lasts"))


@query("SELECT CAST(min(p_partkey) AS VARCHAR) AS entity_id, p_name AS label FROM part GROUP BY p_name")
def write_back_full_text(t):
    """Answers in a full-text store: records by their ids."""
    return _asked(t, "elasticsearch").records.select("entity_id", "label")


@query("SELECT 0::BIGINT AS written")
def write_back_relational(t):
    """A relational store takes no answers."""
    return _asked(t, "postgres").records.agg(F.count("*").alias("written"))


@query("""WITH n AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS entity_id, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_name ELSE p_name END AS label, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name || ' ' || p_brand END AS alias FROM part),
qs AS (SELECT DISTINCT lower(p_name) AS q FROM part UNION SELECT DISTINCT lower(p_name || ' ' || p_brand) FROM part UNION SELECT DISTINCT 'new ' || lower(p_name) FROM part),
l AS (SELECT lower(label) AS q, arg_max(entity_id, k) AS entity_id FROM n GROUP BY lower(label)),
a AS (SELECT lower(alias) AS q, entity_id, k FROM n WHERE alias IS NOT NULL)
SELECT q, entity_id, CAST(1 AS INT) AS ord FROM qs JOIN l USING (q) UNION ALL
SELECT q, entity_id, CAST(row_number() OVER (PARTITION BY q ORDER BY k) AS INT) FROM qs JOIN a USING (q) WHERE q NOT IN (SELECT q FROM l)""")
def stored_keys_lookup(t):
    """Exact lookup in a stored index after a base and a delta that renames every third record."""
    rows, spark = kb._complete(part_kb(t)), t("part").sparkSession
    keys = stored.KeyStore(spark, f"{shared_folder(spark)}/linkloom/keys-{uuid.uuid4().hex}")
    x = kb.Layer("kept", keys=keys)
    x.load(rows)
    x.load(rows.filter("load_ord % 3 = 0").withColumn("label", F.concat(F.lit("new "), "label")).withColumn("aliases", F.array().cast("array<string>")), True)
    p = t("part")
    qs = p.select(F.lower("p_name").alias("q")).union(p.select(F.lower(F.concat_ws(" ", "p_name", "p_brand")))).union(p.select(F.lower(F.concat(F.lit("new "), "p_name")))).distinct()
    return C.exact(qs, x.records, keys)


# --- mentions, links, models by name ----------------------------------------------------------

@query(f"WITH {MEN} SELECT text_idx, count(*) AS n, CAST(sum(e - b) AS BIGINT) AS covered, min(b) AS first FROM m GROUP BY text_idx")
def mention_spans(t):
    """Mentions' spans as a scorer's input, in order."""
    got = L.spans(_mentions(t)).select("text_idx", "spans")
    return got.select("text_idx", F.size("spans").cast("long").alias("n"), F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"])).alias("covered"), F.col("spans")[0]["start"].alias("first"))


@query("WITH x AS (SELECT doc_id AS text_idx, unnest(regexp_extract_all(text, '[0-9]+')) AS d FROM documents) SELECT text_idx, count(*) AS n, CAST(sum(length(d)) AS BIGINT) AS n_chars FROM x WHERE length(d) >= 3 GROUP BY text_idx")
def model_mentions(t):
    """A model registered by name: it finds numbers of two labels with scores, and label and threshold choose."""
    digits = re.compile("[0-9]+")

    def find(text):
        for m in digits.finditer(text):
            yield m.start(), m.end(), "number", 0.9 if len(m[0]) >= 3 else 0.1
        for m in re.finditer("@", text):
            yield m.start(), m.end(), "sign", 1.0

    processors.MODELS["numbers"] = find
    try:
        spark = t("documents").sparkSession
        got = processors.Extract({"model": "numbers", "labels": ["number"], "threshold": 0.5}, spark)(_texts(t))
        return got.groupBy("text_idx").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))
    finally:
        del processors.MODELS["numbers"]


@query()
def tag_mentions(t):
    """Mentions by a tagger that learns what names are from 200 texts, those of the smallest hashes, and the pattern's
    mentions in them; every text is tagged. SQL can't say it: tests hold the tagger against enumeration."""
    texts = _texts(t)
    few = texts.orderBy(F.xxhash64("text_idx"), "text_idx").limit(200)
    known = M.pattern_mentions(few).groupBy("text_idx").agg(F.collect_list(F.struct("start", "end", F.lit("name").alias("label"))).alias("spans"))
    rows = cut(few.join(known, "text_idx", "left").select("text", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,label:string>>")).alias("spans")))
    got = tagger.tag(texts, tagger.train(rows, ["name"], rounds=10))
    return got.select("text_idx", "mention_idx", "text", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query("WITH c AS (SELECT p_size, lower(p_name) AS l, min(p_partkey) AS k FROM part GROUP BY p_size, lower(p_name)) SELECT CAST(p_size AS BIGINT) AS text_idx, CAST(count(*) AS INT) AS n_labels, CAST(sum(k) AS DOUBLE) AS total, CAST(min(k) AS DOUBLE) AS first FROM c GROUP BY p_size")
def label_vectors_in_order(t):
    """The matrix of a text's label vectors, in label order."""
    c = _part_candidates(t).withColumn("embedding", F.array(F.col("entity_id").cast("float")))
    got = L.label_matrix(L.labels(c)).select("text_idx", "matrix")
    return got.select("text_idx", F.size("matrix").alias("n_labels"), F.aggregate("matrix", F.lit(0.0), lambda s, x: s + x[0]).alias("total"), F.col("matrix")[0][0].cast("double").alias("first"))


@query(f"WITH {LINE} SELECT text_idx, row_number() OVER (PARTITION BY text_idx ORDER BY score DESC, link_ord) AS link_ord, b AS start_pos, round(score, 9) AS score FROM li")
def rank_order(t):
    """After ranking the order of links follows the new scores, ties as they were."""
    none = _part_candidates(t).limit(0)
    return L.rank(_lines(t), none, [("gliner_score", 2.0)]).select("text_idx", "link_ord", F.col("start").alias("start_pos"), F.round("score", 9).alias("score"))


@query(f"WITH {AGG} SELECT text_idx, mention_idx, confidence FROM (SELECT *, row_number() OVER (PARTITION BY text_idx ORDER BY mention_idx) AS k FROM staged WHERE is_linked AND confidence >= 0.6) WHERE k <= 25")
def l0_display(t):
    """What an application shows: a text's first 25 confident links."""
    return A.display(_linked(t)).select("text_idx", "mention_idx", "confidence")


# --- contexts, inputs, processors -------------------------------------------------------------

@query("SELECT conv_id AS text_idx, '<' || arg_min(text, turn) || '>' AS value FROM conversations WHERE conv_id >= 10 GROUP BY conv_id")
def input_resolved(t):
    """An input: filter, field of all, first of the list, then a template."""
    ctx = dag.Context()
    ctx.set("talks", _talks(t).withColumnRenamed("conv_id", "text_idx"))
    first = ctx.resolve(dag.Input("talks", fields="turns[*].text", reduce="first", filter="text_idx >= 10"))
    ctx.set("first", first)
    return ctx.resolve(dag.Input("outputs[-1]", template="<{text}>"))


@query("SELECT CAST(p_size AS BIGINT) AS p_size, count(*) AS n, 'kept' AS note FROM part GROUP BY p_size")
def context_saved(t):
    """A context's frames and values after saving and loading: by key, by place, and in order."""
    parts = t("part").groupBy(F.col("p_size").cast("long").alias("p_size")).agg(F.count("*").alias("n"))
    spark = parts.sparkSession
    ctx = dag.Context({"given": 1})
    ctx.set("note", "kept", {"node": "a"})
    ctx.set("sizes", parts)
    folder = f"{shared_folder(spark)}/linkloom/context-{uuid.uuid4().hex}"
    ctx.save(folder)
    back = dag.Context.load(spark, folder)
    ok = back.get_execution_order() == ["note", "sizes"] and back.get_metadata("note") == {"node": "a"} and back.get("outputs[5]") is None and back.has("sizes") and not back.has("$input")
    return back.get("outputs[-1]").withColumn("note", F.lit(back.get("note") if ok else None))


@query("SELECT o_custkey AS text_idx, count(*) AS n FROM orders WHERE o_totalprice >= 100000 GROUP BY o_custkey")
def custom_processor(t):
    """A processor registered by name, with a list of steps, a node that its condition leaves out, implicit order,
    and the output cut to the named fields."""
    methods = {"at_least": lambda df, price: df.filter(F.col("o_totalprice") >= price), "count_by": lambda df, key: df.groupBy(F.col(key).alias("text_idx")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))}

    @registry.register("orders_by_customer")
    def make(config, spark):
        steps = registry.Steps(methods, [tuple(s) for s in config["pipeline"]])
        return lambda rows: steps(rows)

    spark = t("orders").sparkSession
    count = {"id": "count", "processor": "orders_by_customer", "inputs": {"rows": {"source": "kept"}}, "output": {"key": "counts", "fields": ["text_idx", "n"]}, "config": {"pipeline": [["count_by", {"key": "o_custkey"}]]}}
    keep = {"id": "keep", "processor": "orders_by_customer", "inputs": {"rows": {"source": "$input", "fields": "rows"}}, "output": {"key": "kept"}, "config": {"pipeline": [["at_least", {"price": 100000}]]}}
    never = keep | {"id": "never", "output": {"key": "none"}, "condition": "absent"}
    out = dag.Executor({"nodes": [count, never, keep]}, spark).execute({"rows": t("orders")})
    return out.get("counts")
