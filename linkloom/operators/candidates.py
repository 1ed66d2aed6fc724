"""L2: candidate entities of mentions, from the searches of each kind of layer, the chain over layers, and the
steps that follow.

A search takes queries (q, the normalised mention text, distinct) and gives hits (q, entity_id, ord): the
entities found and their order of relevance within a query, from 1 on."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..schema import keep_first, norm, top_k
from ..session import cut
from ..sources import kb

LIMIT = 50


def queries_of(mentions: DataFrame) -> DataFrame:
    return mentions.select(norm(F.col("text")).alias("q")).distinct()


def _ranked(hits: DataFrame, *order) -> DataFrame:
    """Number the hits of each query, each entity at its first place only."""
    first = keep_first(hits, ["q", "entity_id"], *order)
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy(*order))).select("q", "entity_id", "ord")


def exact(queries: DataFrame, records: DataFrame, keys=None) -> DataFrame:
    """Queries that equal a label (the entity loaded last under it), then those that equal an alias. `keys`: a stored
    index of the records' names (sources.stored.KeyStore), which is read in place of them."""
    if keys is not None:
        found = keys.lookup(queries)
        label = found.filter("kind = 'label'").groupBy("q").agg(F.max_by("entity_id", F.struct("load_ord", "entity_id")).alias("entity_id"))
        alias = found.filter("kind = 'alias'").select("q", "entity_id", F.lit(1).alias("kind"), "load_ord")
        return _ranked(label.select("q", "entity_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("load_ord")).unionByName(alias), "kind", "load_ord", "entity_id")
    label = kb.label_index(records).withColumnRenamed("key", "q").withColumn("kind", F.lit(0)).withColumn("load_ord", F.lit(0).cast("long"))
    alias = kb.surface_forms(records).filter("kind = 'alias'").select(F.col("key").alias("q"), "entity_id", F.lit(1).alias("kind"), "load_ord")
    return _ranked(queries.join(label.unionByName(alias), "q"), "kind", "load_ord", "entity_id")


def fuzzy(queries: DataFrame, records: DataFrame, min_similarity: float = 0.75, prefix_length: int = 1) -> DataFrame:
    """Labels that share the query's first characters and are similar enough; else the first such alias. An entity
    whose label doesn't share them is passed over with its aliases. Forms are blocked by the prefix and a band of
    lengths; of each pair of distinct strings lengths and common characters bound the similarity before it is worked
    out, once."""
    r = records.select("entity_id", "load_ord", F.lower("label").alias("lab"), "aliases").withColumn("p", F.substring("lab", 1, prefix_length))
    alias = r.select("entity_id", "load_ord", "p", F.posexplode("aliases").alias("pos", "form")).withColumn("form", F.lower("form")).filter(F.substring("form", 1, prefix_length) == F.col("p"))
    forms = r.select("entity_id", "load_ord", F.lit(-1).alias("pos"), F.col("lab").alias("form")).unionByName(alias.select("entity_id", "load_ord", "pos", "form"))
    # The shorter string has at least t / (2 - t) of the longer one's length: its band is the same or a neighbour.
    width = 1.001 * max(math.log((2 - min_similarity) / min_similarity), 0.05) if 0 < min_similarity else None
    band = lambda c: F.floor(F.log(F.length(c) + 1e-9) / width) if width else F.lit(0)
    p = lambda c: F.substring(c, 1, prefix_length)
    texts = forms.select("form").distinct().select("form", p("form").alias("p"), F.explode(F.array(*[band(F.col("form")) + i for i in ((-1, 0, 1) if width else (0,))])).alias("band"))
    pairs = queries.select("q", p("q").alias("p"), band(F.col("q")).alias("band")).join(texts, ["p", "band"]).filter(S.ratio_possible(F.col("q"), F.col("form"), min_similarity))
    sims = pairs.filter(S.common_possible(F.col("q"), F.col("form"), min_similarity)).withColumn("sim", S.indel_ratio(F.col("q"), F.col("form"))).filter(F.col("sim") >= min_similarity)
    both = keep_first(sims.select("q", "form", "sim").join(forms, "form"), ["q", "entity_id"], "pos")
    return _ranked(both, F.col("sim").desc(), "load_ord", "entity_id")


def key_value(queries: DataFrame, table: DataFrame, now: str | None = None) -> DataFrame:
    """Rows (key, value, expires_at, load_ord) that have not expired; a value is a record or a list of them."""
    at = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    live = table.filter(F.col("expires_at").isNull() | (F.col("expires_at") > at)).withColumnRenamed("key", "q")
    one = F.array(F.get_json_object("value", "$.entity_id"))
    many = F.from_json("value", "array<struct<entity_id:string>>")["entity_id"]
    ids = F.when(F.col("value").startswith("["), many).otherwise(one)
    hits = queries.join(live, "q").select("q", F.posexplode(ids).alias("pos", "entity_id"), "load_ord")
    return _ranked(hits, F.col("load_ord").desc(), "pos")


def contains(queries: DataFrame, records: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Labels or aliases that hold the query anywhere, by popularity. Queries of three characters or more are
    joined by that of their trigrams which the fewest forms have, shorter ones by all of their characters."""
    forms = kb.surface_forms(records)
    gram = lambda c, k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.substring(c, i, F.lit(k))))
    grams = None
    for k in (1, 2, 3):
        part = forms.filter(F.length("key") >= k).select("entity_id", "key", F.explode(gram(F.col("key"), k)).alias("g"))
        grams = part if grams is None else grams.unionByName(part)
    size = F.least(F.length("q"), F.lit(3))
    want = queries.filter(F.length("q") > 0).select("q", F.explode(F.when(size == 3, gram(F.col("q"), 3)).otherwise(F.array("q"))).alias("g"))
    met = want.join(grams.groupBy("g").agg(F.count("*").alias("n")), "g", "left")  # a trigram that no form has ends a query
    rare = met.groupBy("q").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    hit = rare.join(grams, "g").filter(F.col("key").contains(F.col("q"))).select("q", "entity_id").distinct()
    hit = hit.join(records.select("entity_id", "popularity"), "entity_id")
    return _ranked(top_k(hit, ["q"], limit, F.col("popularity").desc(), "entity_id"), F.col("popularity").desc(), "entity_id")


def trigram(queries: DataFrame, records: DataFrame, min_similarity: float = 0.3, limit: int = LIMIT) -> DataFrame:
    """Labels by trigram similarity. Of two sets of trigrams that are alike enough one of the rarest n - ceil(t n) + 1
    of either is common to both (rarest first by their numbers among the labels), so only those are joined; pairs
    of distinct strings whose sizes allow the similarity are then compared in full."""
    r = records.select("entity_id", "popularity", F.lower("label").alias("lab"))
    sides = {"q": queries.select("q"), "lab": r.select("lab").distinct()}
    grams = {k: d.withColumn("g", S.trigrams(F.col(k))).filter(F.size("g") > 0) for k, d in sides.items()}
    df = grams["lab"].select(F.explode("g").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    rows = {}
    for k, d in grams.items():
        t = d.select(k, "g", F.explode("g").alias("t")).join(df, "t", "left").groupBy(k).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("o"))
        take = F.size("o") - F.ceil(F.size("o") * F.lit(float(min_similarity)) - 1e-9).cast("int") + 1
        rows[k] = t.select(k, F.col("o.t").alias(f"g_{k}"), F.explode(F.slice(F.col("o.t"), 1, F.greatest(F.least(take, F.size("o")), F.lit(1)))).alias("t"))
    nq, nr = F.size("g_q"), F.size("g_lab")
    pairs = rows["q"].join(rows["lab"], "t").filter(F.least(nq, nr) >= F.greatest(nq, nr) * F.lit(float(min_similarity)) - 1e-9).drop("t").dropDuplicates(["q", "lab"])
    both = F.size(F.array_intersect("g_q", "g_lab"))
    sim = pairs.withColumn("sim", both / (nq + nr - both)).filter(F.col("sim") >= min_similarity).select("q", "lab", "sim").join(r, "lab")
    order = [F.col("sim").desc(), F.col("popularity").desc(), "entity_id"]
    return _ranked(top_k(sim, ["q"], limit, *order), *order)


def postings(records: DataFrame) -> DataFrame:
    """(entity_id, field, term, tf, length) of labels, aliases and descriptions."""
    fields = [("label", F.col("label"), 2.0), ("aliases", F.array_join("aliases", " "), 1.5), ("description", F.col("description"), 1.0)]
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(w).alias("boost"), c.alias("v")) for n, c, w in fields])).alias("f")
    terms = F.regexp_extract_all(F.lower("f.v"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    t = records.select("entity_id", parts).select("entity_id", "f.field", "f.boost", terms.alias("terms"))
    return t.select("entity_id", "field", "boost", F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy("entity_id", "field", "boost", "length", "term").agg(F.count("*").alias("tf"))


def full_text(queries: DataFrame, records: DataFrame, max_distance: int = 0, prefix_length: int = 1, max_expansions: int = 50, limit: int = LIMIT) -> DataFrame:
    """BM25 over three fields, the best field's sum counting (label twice, aliases one and a half times). With
    max_distance, a term also stands for index terms that share its prefix within that many edits or swaps of
    neighbours, the nearest max_expansions of them. Entities of the same fields score alike, so each class of them is
    scored once, under its smallest id, and counts by its size; a query's best classes then give their first ids."""
    docs = records.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("label", "aliases", "description"))).alias("doc"))
    classes = docs.groupBy("doc").agg(F.min("entity_id").alias("class"), F.count("*").alias("members"))
    post = postings(classes.select(F.col("class").alias("entity_id"), F.inline("doc"))).join(classes.select(F.col("class").alias("entity_id"), "members"), "entity_id")
    n = post.select("entity_id", "field", "length", "members").distinct().groupBy("field").agg(F.sum("members").alias("n"), (F.sum(F.col("length") * F.col("members")) / F.sum("members")).alias("mean"))
    df = post.groupBy("field", "term").agg(F.sum("members").alias("df"))
    want = queries.select("q", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))).alias("term"))
    if max_distance:
        # Symmetric deletion: terms of the index and of queries meet where both have lost up to so many characters.
        p, gone = F.substring("term", 1, prefix_length), F.explode(S.deletions(F.col("term"), max_distance, prefix_length)).alias("gone")
        vocab = df.select("term").distinct().select(F.col("term").alias("v"), p.alias("p"), gone)
        near = want.select("term").distinct().select("term", p.alias("p"), gone).join(vocab, ["p", "gone"]).select("term", "v").distinct()
        near = near.withColumn("d", S.edit_distance(F.col("term"), F.col("v"), max_distance)).filter(F.col("d") <= max_distance)
        near = top_k(near, ["term"], max_expansions, "d", "v").select("term", "v")
        want = want.join(near, "term").select("q", F.col("v").alias("term")).distinct()
    hit = want.join(post, "term").join(F.broadcast(n), "field").join(df, ["field", "term"])
    score = F.col("boost") * S.bm25_term(F.col("tf"), F.col("length"), F.col("mean"), F.col("df"), F.col("n"))
    per = hit.groupBy("q", "entity_id", "field").agg(F.sum(score).alias("s")).groupBy("q", "entity_id").agg(F.max("s").alias("s"))
    per = per.withColumn("s", F.round("s", 6))
    order = [F.col("s").desc(), "entity_id"]
    # An entity of a class after the first `limit` comes after each of their smallest ids.
    best = top_k(per, ["q"], limit, *order).withColumnRenamed("entity_id", "class")
    ids = top_k(docs, ["doc"], limit, "entity_id").join(classes.select("doc", "class"), "doc").select("class", "entity_id")
    return _ranked(top_k(best.join(ids, "class").select("q", "entity_id", "s"), ["q"], limit, *order), *order)


def search_layer(queries: DataFrame, layer: kb.Layer, now: str | None = None, modes: list[str] | None = None) -> DataFrame:
    """Hits of one layer: its search modes (or the given ones) one after the other, each entity once."""
    out, f = None, layer.fuzzy
    for rank, mode in enumerate(modes or layer.search_mode):
        if layer.kind == "redis":
            part = key_value(queries, layer.key_values(now), now) if mode == "exact" else None
        elif layer.kind == "elasticsearch":
            part = full_text(queries, layer.records, f.get("max_distance", 2) if mode == "fuzzy" else 0, f.get("prefix_length", 1))
        elif layer.kind == "postgres":
            part = contains(queries, layer.records) if mode == "exact" else trigram(queries, layer.records, f.get("min_similarity", 0.3))
        else:
            part = exact(queries, layer.records, layer.keys) if mode == "exact" else fuzzy(queries, layer.records, f.get("min_similarity", 0.3), f.get("prefix_length", 1))
        if part is not None:
            part = part.withColumn("mode_rank", F.lit(rank))
            out = part if out is None else out.unionByName(part)
    return _ranked(out, "mode_rank", "ord")


def search_chain(queries: DataFrame, layers: list[kb.Layer], now: str | None = None) -> DataFrame:
    """(q, entity_id, ord, layer_rank): the first layer with any hit answers a query; a lower one sees only the
    queries that all above it missed."""
    out, open_ = None, queries
    for rank, layer in enumerate(layers):
        part = search_layer(open_, layer, now).withColumn("layer_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
        open_ = open_.join(part.select("q").distinct(), "q", "left_anti")
    return out


def cache_writes(queries: DataFrame, hits: DataFrame, layers: list[kb.Layer]) -> DataFrame:
    """What answering writes back: (layer, q, entity_id, ord, ttl, layer_rank) for each writable layer of a priority
    above that of the layer that answered (layer_rank). Policy always writes all, miss those that an exact search of
    the layer doesn't find, hit those that it does (a layer may have them and not be asked in that mode)."""
    out = None
    for layer in layers:
        below = [r for r, x in enumerate(layers) if x.priority < layer.priority]
        if not below or not layer.write or layer.cache_policy not in ("always", "miss", "hit") or layer.kind == "postgres":
            continue
        rows = hits.filter(F.col("layer_rank").isin(below))
        if layer.cache_policy != "always":
            own = search_layer(queries, layer, modes=["exact"]).select("q").distinct()
            rows = rows.join(own, "q", "left_anti" if layer.cache_policy == "miss" else "left_semi")
        part = rows.select(F.lit(layer.name).alias("layer"), "q", "entity_id", "ord", F.lit(layer.ttl).alias("ttl"), "layer_rank")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else hits.limit(0).select(F.lit("").alias("layer"), "q", "entity_id", "ord", F.lit(0).alias("ttl"), "layer_rank")


def _layer_records(layers: list[kb.Layer]) -> DataFrame:
    """The records of all layers with layer_rank and hit_layer."""
    records = None
    for rank, x in enumerate(layers):
        part = x.found_records().withColumn("layer_rank", F.lit(rank)).withColumn("hit_layer", F.lit(x.name))
        records = part if records is None else records.unionByName(part, allowMissingColumns=True)
    return records


def write_back(queries: DataFrame, hits: DataFrame, chain: kb.Chain, now: str | None = None) -> None:
    """Let the layers receive what cache_writes says. Answers of one call are written after all of its searches, so
    they serve the next call."""
    layers = chain.usable()
    takers = [x for x in layers if x.write and x.kind != "postgres" and any(y.priority < x.priority for y in layers)]
    if not takers:
        return
    rows = cut(cache_writes(queries, hits, layers).join(_layer_records(layers).drop("hit_layer"), ["entity_id", "layer_rank"]).drop("layer_rank"))
    for x in takers:
        x.receive(rows.filter(F.col("layer") == x.name).drop("layer", "ttl"), now)


def filter_by_popularity(candidates: DataFrame, min_popularity: int = 0) -> DataFrame:
    return candidates.filter(F.col("popularity") >= min_popularity)


def deduplicate_candidates(candidates: DataFrame) -> DataFrame:
    return keep_first(candidates, ["text_idx", "mention_idx", "entity_id"], "ord")


def limit_candidates(candidates: DataFrame, limit: int = 30) -> DataFrame:
    """The first of each mention by relevance, before any sort by popularity."""
    return top_k(candidates, ["text_idx", "mention_idx"], limit, "ord", "entity_id")


def sort_by_popularity(candidates: DataFrame) -> DataFrame:
    """cand_ord: the order by popularity within a mention, ties by relevance."""
    w = Window.partitionBy("text_idx", "mention_idx").orderBy(F.col("popularity").desc(), "ord", "entity_id")
    return candidates.withColumn("cand_ord", F.row_number().over(w))


METHODS = {"filter_by_popularity": filter_by_popularity, "deduplicate_candidates": deduplicate_candidates, "limit_candidates": limit_candidates, "sort_by_popularity": sort_by_popularity}


def unique_candidates(candidates: DataFrame, limit: int | None = 50) -> DataFrame:
    """The candidates of all texts, each entity once, the most popular `limit` of them: what an application lists."""
    once = keep_first(candidates, ["entity_id"], "text_idx", "mention_idx", "cand_ord")
    return once.orderBy(F.col("popularity").desc(), "entity_id").limit(limit) if limit else once


def all_entities(records: DataFrame) -> DataFrame:
    """Without mentions the whole knowledge base is every text's candidate list, whatever limit or popularity say. It is
    given once, with a null text_idx: later steps share it."""
    return records.select(F.lit(None).cast("long").alias("text_idx"), F.lit(0).cast("long").alias("mention_idx"), "*", F.col("load_ord").alias("ord"), F.col("load_ord").alias("cand_ord")).drop("load_ord")


def candidates(mentions: DataFrame, chain: kb.Chain, max_candidates: int = 30, min_popularity: int = 0, steps: list[tuple[str, dict]] | None = None, cache: bool = False) -> DataFrame:
    """The whole layer: search, then filter, dedup, limit, sort. With cache, answers are written back to the layers above."""
    layers = chain.usable()
    queries = queries_of(mentions)
    hits = search_chain(queries, layers)
    records = _layer_records(layers)
    if cache and any(x.write and any(y.priority < x.priority for y in layers) for x in layers):
        hits = cut(hits)
        write_back(queries, hits, chain)
    # Candidates depend on a mention's text only: the steps go over distinct texts, in the place of mentions.
    out = hits.join(records.drop("load_ord"), ["entity_id", "layer_rank"]).drop("layer_rank").withColumn("text_idx", F.lit(0).cast("long")).withColumnRenamed("q", "mention_idx")
    for name, kw in steps or [("filter_by_popularity", {"min_popularity": min_popularity}), ("deduplicate_candidates", {}), ("limit_candidates", {"limit": max_candidates}), ("sort_by_popularity", {})]:
        out = METHODS[name](out, **kw)
    out = out.drop("text_idx").withColumnRenamed("mention_idx", "q")
    return mentions.select("text_idx", "mention_idx", norm(F.col("text")).alias("q")).join(out, "q").drop("q")


def flat_mentions(spark: SparkSession, texts: list[str], structure: list[list[str]] | None = None) -> DataFrame:
    """A flat list of mention texts as mentions: all of one text, or dealt to texts as `structure` (lists as long as
    each text's mentions) says; what it has no place for goes."""
    if structure is None:
        rows = [(0, i, t) for i, t in enumerate(texts)]
    else:
        rows, at = [], 0
        for k, group in enumerate(structure):
            rows += [(k, i, t) for i, t in enumerate(texts[at: at + len(group)])]
            at += len(group)
    return spark.createDataFrame(rows, "text_idx long, mention_idx long, text string")
