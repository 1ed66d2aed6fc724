"""One query for each operator over the given tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .operators import aggregate as A
from .operators import candidates as C
from .operators import gazetteer as G
from .operators import links as L
from .operators import mentions as M
from .operators import scorer
from .plans.builder import ConfigBuilder, Factory
from .schema import template, top_k
from .session import cut, prepare, shared_folder
from .sources import kb, stores

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- shared pieces: mentions of the documents, and a knowledge base made of them --------------

TOK = r"""tok AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM
  (SELECT doc_id, regexp_extract_all(text, '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)') AS t FROM documents)),
off AS (SELECT doc_id, pos, tok, CAST(sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY pos) - length(tok) AS BIGINT) AS s FROM tok)"""
MEN = TOK + r""",
m AS (SELECT doc_id AS text_idx, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS mention_idx, tok AS text, CAST(s AS INT) AS b, CAST(s + length(tok) AS INT) AS e
  FROM off WHERE regexp_full_match(tok, '\p{Lu}\p{L}{3,}'))"""
KB = MEN + """,
kb AS (SELECT 'T:' || lower(text) AS entity_id, lower(text) AS label, lower(text) || 's' AS alias, count(DISTINCT text_idx) AS popularity FROM m GROUP BY lower(text) HAVING count(DISTINCT text_idx) >= 5)"""
# Links made of the mentions: two of three, shifted by up to three places, some with a label of no entity.
LNK = KB + """,
raw AS (SELECT text_idx, mention_idx AS link_ord, text, CASE WHEN mention_idx % 7 = 6 THEN 'none ' ELSE '' END || lower(text) AS label, CAST(b + mention_idx % 4 AS INT) AS b, CAST(e + mention_idx % 4 AS INT) AS e,
  round((mention_idx % 10) / 10.0, 6)::DOUBLE AS score FROM m WHERE mention_idx % 3 <> 0),
idx AS (SELECT text_idx, b, e, min(link_ord) AS pos, arg_max(label, link_ord) AS label, arg_max(score, link_ord) AS score FROM raw GROUP BY text_idx, b, e)"""


def agg_sql(tolerance: int = 2, kind: str = "") -> str:
    """The whole of L0 in SQL. kind: what the label template puts after a label."""
    return LNK.replace("lower(text) AS label, CAST(b +", f"lower(text) || '{kind}' AS label, CAST(b +") + f""",
hit AS (SELECT m.text_idx, m.mention_idx, i.b AS lb, i.e AS le, i.label, i.score, row_number() OVER (PARTITION BY m.text_idx, m.mention_idx ORDER BY (m.b <> i.b OR m.e <> i.e), i.pos) AS k
  FROM m JOIN idx i ON m.text_idx = i.text_idx AND abs(m.b - i.b) <= {tolerance} AND abs(m.e - i.e) <= {tolerance}),
cand AS (SELECT m.text_idx, m.mention_idx AS occ, kb.entity_id, kb.label, kb.alias FROM m JOIN kb ON lower(m.text) = kb.label OR lower(m.text) = kb.alias),
names AS (SELECT text_idx, label AS key FROM cand UNION ALL SELECT text_idx, alias FROM cand),
nc AS (SELECT m.text_idx, m.mention_idx, count(*) AS n FROM m JOIN names USING (text_idx) WHERE names.key = lower(m.text) GROUP BY ALL),
agg AS (SELECT m.text_idx, m.mention_idx, m.text, coalesce(nc.n, 0) AS num_candidates, h.label IS NOT NULL AS is_linked, h.lb, h.le,
  CASE WHEN h.label IS NOT NULL THEN coalesce((SELECT min(c.entity_id) FROM cand c WHERE c.text_idx = m.text_idx AND c.label || '{kind}' = h.label),
    (SELECT arg_min(c.entity_id, c.occ * 10000 + length(c.entity_id)) FROM cand c WHERE c.text_idx = m.text_idx AND contains(h.label, c.label)), 'unknown') END AS entity_id,
  h.score AS confidence FROM m LEFT JOIN hit h ON m.text_idx = h.text_idx AND m.mention_idx = h.mention_idx AND h.k = 1 LEFT JOIN nc ON nc.text_idx = m.text_idx AND nc.mention_idx = m.mention_idx),
staged AS (SELECT *, CASE WHEN is_linked THEN 'l3_linked' WHEN num_candidates > 0 THEN 'l2_found' ELSE 'l1_only' END AS stage FROM agg)"""


AGG = agg_sql()


def _texts(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("text_idx"), "text")


def _mentions(t) -> DataFrame:
    return M.pattern_mentions(_texts(t))


def corpus_kb(mentions: DataFrame, least: int = 5) -> DataFrame:
    """Terms that enough texts mention as records; popularity is the number of texts."""
    k = mentions.groupBy(F.lower("text").alias("label")).agg(F.countDistinct("text_idx").alias("popularity")).filter(F.col("popularity") >= least)
    return k.select(F.concat(F.lit("T:"), "label").alias("entity_id"), "label", F.array(F.concat("label", F.lit("s"))).alias("aliases"), F.lit("").alias("description"), F.lit("term").alias("entity_type"),
                    "popularity", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model_id"), F.crc32(F.col("label").cast("binary")).alias("load_ord"))


def _links(m: DataFrame, kind: str = "") -> DataFrame:
    i = F.col("mention_idx")
    label = F.concat(F.when(i % 7 == 6, "none ").otherwise(""), F.lower("text"), F.lit(kind))
    score = F.round(i % 10 / 10.0, 6)
    return m.filter(i % 3 != 0).select("text_idx", i.alias("link_ord"), "text", label.alias("label"), (F.col("start") + i % 4).cast("int").alias("start"), (F.col("end") + i % 4).cast("int").alias("end"),
                                       score.alias("score"), F.create_map(label, score).alias("class_probs"))


def _linked(t, strict: bool = True, tolerance: int = 2, kind: str = "") -> DataFrame:
    m = cut(_mentions(t))
    k = cut(corpus_kb(m))
    chain = kb.Chain([kb.Layer("terms", "dict", search_mode=["exact"], records=k)])
    c = cut(C.candidates(m, chain, 30, 0))
    return A.aggregate(m, c, _links(m, kind), "{label} ({entity_type})" if kind else "{label}", tolerance, strict)


def part_kb(t) -> DataFrame:
    """Parts as records: many share a label; brand and label together are an alias."""
    return t("part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("label"), F.array(F.concat_ws(" ", "p_name", "p_brand")).alias("aliases"), F.col("p_type").alias("description"),
                            F.lit("part").alias("entity_type"), F.col("p_size").cast("long").alias("popularity"), F.col("p_partkey").alias("load_ord"))


def names_kb(t) -> DataFrame:
    """One record for each distinct part name."""
    return t("part").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("load_ord"), F.max("p_size").cast("long").alias("popularity")) \
        .select(F.col("load_ord").cast("string").alias("entity_id"), "label", F.array().cast("array<string>").alias("aliases"), F.lit("").alias("description"), "popularity", "load_ord")


NAMES = "nm AS (SELECT p_name AS label, CAST(min(p_partkey) AS VARCHAR) AS entity_id, min(p_partkey) AS ord0, CAST(max(p_size) AS BIGINT) AS pop FROM part GROUP BY p_name)"
BROKEN = "qs AS (SELECT DISTINCT lower(substr(p_name, 1, 1) || substr(p_name, 3)) AS q FROM part)"


def _broken(t) -> DataFrame:
    """Part names without their second character."""
    n = F.col("p_name")
    return t("part").select(F.lower(F.concat(F.substring(n, 1, 1), n.substr(F.lit(3), F.length(n)))).alias("q")).distinct()


# --- L1 ---------------------------------------------------------------------------------------

@query(f"WITH {TOK} SELECT doc_id AS text_idx, count(*) AS n_tokens, CAST(sum(s) AS BIGINT) AS sum_start FROM off GROUP BY doc_id")
def tokens_offsets(t):
    return M.tokens(_texts(t)).groupBy("text_idx").agg(F.count("*").alias("n_tokens"), F.sum("start").alias("sum_start"))


@query(f"WITH {MEN} SELECT text_idx, mention_idx, text, b AS start_pos, e AS end_pos FROM m")
def mention_extract(t):
    return _mentions(t).select("text_idx", "mention_idx", "text", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query(f"WITH {MEN} SELECT text_idx, mention_idx, trim(substr(d.text, greatest(b - 50, 0) + 1, least(b, 50)), E' \\n\\t\\r') AS left_context, trim(substr(d.text, e + 1, 50), E' \\n\\t\\r') AS right_context FROM m JOIN documents d ON d.doc_id = m.text_idx")
def mention_context(t):
    return _mentions(t).select("text_idx", "mention_idx", "left_context", "right_context")


@query(f"WITH {MEN}, w AS (SELECT text_idx, text, b // 10 AS b, min(mention_idx) AS mention_idx FROM m GROUP BY text_idx, b // 10, text), f AS (SELECT text_idx, b, min(mention_idx) AS mention_idx FROM w GROUP BY text_idx, b) SELECT text_idx, mention_idx, CAST(b AS INT) AS start_pos FROM f")
def mention_dedup(t):
    m = _mentions(t).withColumn("start", F.floor(F.col("start") / 10).cast("int")).withColumn("end", F.col("start"))
    return M.deduplicate(m).select("text_idx", "mention_idx", F.col("start").alias("start_pos"))


@query(f"WITH {MEN} SELECT text_idx, mention_idx, text FROM m WHERE length(text) >= 12")
def mention_min_length(t):
    return M.filter_by_length(_mentions(t), 12).select("text_idx", "mention_idx", "text")


@query(f"WITH {MEN}, x AS (SELECT text_idx, mention_idx, text, b, e FROM m WHERE mention_idx % 2 = 0), y AS (SELECT text_idx, b - 3 AS b, e + 3 AS e FROM m WHERE mention_idx % 2 = 1) SELECT x.text_idx, count(*) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.text_idx = x.text_idx AND NOT (x.e <= y.b OR x.b >= y.e)) GROUP BY x.text_idx")
def mention_non_overlapping(t):
    m = _mentions(t)
    base = m.filter("mention_idx % 2 = 1").withColumn("start", F.col("start") - 3).withColumn("end", F.col("end") + 3)
    got = M.add_non_overlapping(base, m.filter("mention_idx % 2 = 0"), 1)
    return got.filter("label = 'NOUN_CHUNK'").groupBy("text_idx").agg(F.count("*").alias("n"))


@query(f"WITH {MEN} SELECT text_idx, CAST(row_number() OVER (PARTITION BY text_idx ORDER BY b) - 1 AS BIGINT) AS mention_idx, text, b AS start_pos FROM m")
def mention_sort(t):
    m = _mentions(t)
    return M.sort_by_position(m.withColumn("mention_idx", -F.col("mention_idx"))).select("text_idx", "mention_idx", "text", F.col("start").alias("start_pos"))


@query(f"WITH {KB}, names AS (SELECT label AS key FROM kb UNION SELECT alias FROM kb) SELECT doc_id AS text_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS mention_idx, tok AS text, CAST(s AS INT) AS start_pos FROM off JOIN names ON key = lower(tok)")
def gazetteer_lookup(t):
    k = cut(corpus_kb(_mentions(t)))
    return G.gazetteer_mentions(_texts(t), kb.surface_forms(k)).select("text_idx", "mention_idx", "text", F.col("start").alias("start_pos"))


# Names of 1 to 12 words (signs after the last letters are part of the name) that begin with a letter or digit.
NAMED = r"""names AS (SELECT DISTINCT lower(array_to_string(string_split(text, ' ')[1:CAST(item_id % 12 + 1 AS INT)], ' ')) AS key FROM benchmark),
starts AS (SELECT key, regexp_extract(key, '^[\p{L}\p{N}]+') AS first FROM names WHERE regexp_matches(key, '^[\p{L}\p{N}]'))"""


@query(rf"""WITH {TOK}, {NAMED}
SELECT o.doc_id AS text_idx, CAST(s AS INT) AS start_pos, CAST(s + length(key) AS INT) AS end_pos FROM off o JOIN starts ON first = lower(tok) JOIN documents d ON d.doc_id = o.doc_id
WHERE lower(substr(d.text, s + 1, length(key))) = key AND NOT regexp_full_match(substr(d.text, s + length(key), 2), '[\p{{L}}\p{{N}}]{{2}}')""")
def gazetteer_names(t):
    """Names of one to twelve words, some ending in a sign, wherever they stand in the documents."""
    words = F.slice(F.split("text", " "), 1, (F.col("item_id") % 12 + 1).cast("int"))
    names = t("benchmark").select(F.lower(F.array_join(words, " ")).alias("key")).filter(F.col("key").rlike(r"^[\p{L}\p{N}]"))
    return G.gazetteer_mentions(_texts(t), names).select("text_idx", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


# --- knowledge base ---------------------------------------------------------------------------

def _brands(t) -> DataFrame:
    return t("part").select(F.col("p_name").alias("entity_id"), F.col("p_brand").alias("label"), F.col("p_partkey").alias("load_ord"))


@query("SELECT p_name AS entity_id, arg_min(p_brand, p_partkey) AS label FROM part GROUP BY p_name")
def kb_load_keep_first(t):
    return kb.upsert(None, _brands(t)).select("entity_id", "label")


@query("SELECT p_name AS entity_id, arg_max(p_brand, p_partkey) AS label FROM part GROUP BY p_name")
def kb_load_overwrite(t):
    rows = _brands(t)
    return kb.upsert(kb.upsert(None, rows.filter("load_ord % 2 = 0")), rows, True).select("entity_id", "label")


@query("SELECT lower(p_name) AS key, CAST(max(p_partkey) AS VARCHAR) AS entity_id FROM part GROUP BY lower(p_name)")
def kb_label_last_wins(t):
    return kb.label_index(part_kb(t))


@query("SELECT kind, count(*) AS n, count(DISTINCT key) AS keys FROM (SELECT 'label' AS kind, lower(p_name) AS key FROM part UNION ALL SELECT 'alias', lower(p_name || ' ' || p_brand) FROM part) GROUP BY kind")
def kb_surface_forms(t):
    return kb.surface_forms(part_kb(t)).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS entity_id, CASE WHEN vec_id IS NOT NULL THEN 'm2' END AS embedding_model_id, CAST(embedding[1] AS DOUBLE) AS v1, CAST(len(embedding) AS INT) AS size FROM part LEFT JOIN embeddings ON p_partkey = vec_id + 1")
def kb_update_embeddings(t):
    v = t("embeddings").select((F.col("vec_id") + 1).cast("string").alias("entity_id"), "embedding")
    got = kb.update_embeddings(kb._complete(part_kb(t)), v, "m2")
    return got.select("entity_id", "embedding_model_id", F.try_element_at("embedding", F.lit(1)).cast("double").alias("v1"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("size"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS entity_id, CAST(length(p_name || ': ' || p_type) AS DOUBLE) AS v1, 'm3' AS embedding_model_id FROM part")
def kb_precompute(t):
    chain = kb.Chain([kb.Layer("a", records=kb._complete(part_kb(t)))])
    chain.precompute(lambda c: F.array(F.length(c).cast("float")), "{label}: {description}", "m3")
    return chain.layers[0].records.select("entity_id", F.col("embedding")[0].cast("double").alias("v1"), "embedding_model_id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS entity_id, p_name AS label, CAST(p_size AS BIGINT) AS popularity, p_type AS description FROM part")
def kb_read_jsonl(t):
    """Records of JSON lines among which blank, broken and incomplete ones stand."""
    p = part_kb(t)
    lines = p.select(F.to_json(F.struct("entity_id", "label", "aliases", "description", "popularity")).alias("value"))
    bad = p.select(F.element_at(F.array(F.lit(""), F.lit("{broken"), F.to_json(F.struct("entity_id")), F.lit("   ")), (F.col("load_ord") % 4 + 1).cast("int")).alias("value"))
    path = f"{shared_folder(p.sparkSession)}/linkloom/lines-{uuid.uuid4().hex}"
    lines.unionByName(bad).write.text(path)
    return kb.load_source(p.sparkSession, path).select("entity_id", "label", "popularity", "description")


@query("SELECT count(*) AS n, CAST(sum(length(n_name)) AS BIGINT) AS n_chars FROM nation")
def texts_from_lines(t):
    """Names written as lines of text and read as texts, in a random order that a seed fixes."""
    names = t("nation").select(F.col("n_name").alias("value"))
    path = f"{shared_folder(names.sparkSession)}/linkloom/texts-{uuid.uuid4().hex}"
    names.write.text(path)
    got = stores.sample_texts(stores.read_texts(names.sparkSession, path), 1000)
    return got.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query(f"WITH {MEN} SELECT text_idx, mention_idx FROM m WHERE mention_idx % 2 = 0 OR lower(text) <> lower(substr(text, 1, 5))")
def mention_own_type(t):
    """Every other mention has its text's first five characters as its type: it goes if that is all it says."""
    m = _mentions(t).withColumn("label", F.when(F.col("mention_idx") % 2 == 1, F.upper(F.substring("text", 1, 5))))
    return M.differs_from_label(m).select("text_idx", "mention_idx")


@query("WITH n AS (SELECT count(DISTINCT p_name) AS n FROM part) SELECT n AS first_load, CAST(0 AS BIGINT) AS again, n AS overwritten, n AS stored FROM n")
def kb_load_counts(t):
    rows, layer = _brands(t), kb.Layer("a")
    counts = [layer.load(rows), layer.load(rows), layer.load(rows, True), layer.count()]
    return rows.sparkSession.createDataFrame([counts], "first_load long, again long, overwritten long, stored long")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS entity_id, n_name AS label, r_name AS entity_type FROM nation JOIN region ON n_regionkey = r_regionkey")
def kb_field_mapping(t):
    raw = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return kb.map_fields(raw, {"entity_id": "n_nationkey", "label": "n_name", "entity_type": "r_name"}, "store").select("entity_id", "label", "entity_type")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS entity_id, string_agg(n_name, '|' ORDER BY n_name) AS aliases FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def kb_aliases_aggregated(t):
    e = t("region").select(F.col("r_regionkey").cast("string").alias("entity_id"), F.col("r_name").alias("label"), F.lit(None).cast("string").alias("description"))
    a = t("nation").select(F.col("n_regionkey").cast("string").alias("entity_id"), F.col("n_name").alias("alias"))
    return stores.with_aliases(e, a).select("entity_id", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT entity_id, arg_min(src, rnk) AS src FROM (SELECT p_name AS entity_id, 'a' AS src, 0 AS rnk FROM part WHERE p_size < 10 UNION ALL SELECT p_name, 'b', 1 FROM part) GROUP BY entity_id")
def kb_all_entities(t):
    p = t("part").select(F.col("p_name").alias("entity_id"), F.col("p_name").alias("label"), "p_size", F.col("p_partkey").alias("load_ord"))
    chain = kb.Chain([kb.Layer("b", priority=1, records=p.drop("p_size").withColumn("src", F.lit("b"))), kb.Layer("a", priority=2, records=p.filter("p_size < 10").drop("p_size").withColumn("src", F.lit("a")))])
    return chain.all_entities().select("entity_id", "src")


# --- L2 ---------------------------------------------------------------------------------------

EXACT = """qs AS (SELECT DISTINCT lower(p_name) AS q FROM part UNION SELECT DISTINCT lower(p_name || ' ' || p_brand) FROM part),
h AS (SELECT q, CAST(max(p_partkey) AS VARCHAR) AS id, 0 AS kind, 0 AS o FROM qs JOIN part ON lower(p_name) = q GROUP BY q UNION ALL SELECT q, CAST(p_partkey AS VARCHAR), 1, p_partkey FROM qs JOIN part ON lower(p_name || ' ' || p_brand) = q)"""


def _both_names(t) -> DataFrame:
    p = t("part")
    return p.select(F.lower("p_name").alias("q")).union(p.select(F.lower(F.concat_ws(" ", "p_name", "p_brand")))).distinct()


@query(f"WITH {EXACT} SELECT q, id AS entity_id, CAST(row_number() OVER (PARTITION BY q ORDER BY kind, o, id) AS INT) AS ord FROM h")
def exact_lookup(t):
    return C.exact(_both_names(t), part_kb(t))


RATIO = f"""{NAMES}, {BROKEN}, pairs AS (SELECT q, lower(label) AS l, entity_id, ord0 FROM qs JOIN nm ON substr(q, 1, 1) = lower(substr(label, 1, 1))),
dp AS (SELECT q, l, entity_id, ord0, 0 AS i, [0 FOR x IN range(0, length(l) + 1)] AS r FROM pairs
  UNION ALL SELECT q, l, entity_id, ord0, i + 1, list_concat([0], (SELECT [list_max(c[1:j]) FOR j IN range(1, length(l) + 1)] FROM (SELECT [greatest(r[j + 1], CASE WHEN substr(l, CAST(j AS INT), 1) = substr(q, i + 1, 1) THEN r[j] + 1 ELSE 0 END) FOR j IN range(1, length(l) + 1)] AS c))) FROM dp WHERE i < length(q)),
sim AS (SELECT q, entity_id, ord0, 2.0 * r[-1] / (length(q) + length(l)) AS s FROM dp WHERE i = length(q))"""


@query(f"WITH RECURSIVE {RATIO} SELECT q, entity_id, CAST(row_number() OVER (PARTITION BY q ORDER BY s DESC, ord0, entity_id) AS INT) AS ord FROM sim WHERE s >= 0.75")
def fuzzy_ratio_lookup(t):
    return C.fuzzy(_broken(t), names_kb(t), 0.75, 1)


TRI = f"""{NAMES}, {BROKEN},
tg(s) AS (SELECT q FROM qs UNION SELECT lower(label) FROM nm),
tw AS (SELECT s, '  ' || unnest(regexp_extract_all(s, '([\\p{{L}}\\p{{N}}]+)')) || ' ' AS w FROM tg),
tt AS (SELECT s, list_distinct(flatten(list([substr(w, CAST(j AS INT), 3) FOR j IN range(1, length(w) - 1)]))) AS g FROM tw GROUP BY s),
sim AS (SELECT q, entity_id, pop, len(list_intersect(a.g, b.g)) * 1.0 / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS s FROM qs JOIN tt a ON a.s = q, nm JOIN tt b ON b.s = lower(label))"""


@query(f"WITH {TRI} SELECT q, entity_id, CAST(ord AS INT) AS ord FROM (SELECT q, entity_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, pop DESC, entity_id) AS ord FROM sim WHERE s >= 0.3) WHERE ord <= 50")
def trigram_lookup(t):
    return C.trigram(_broken(t), names_kb(t), 0.3)


@query("WITH qs AS (SELECT DISTINCT lower(substr(p_name, 3, 5)) AS q FROM part UNION SELECT DISTINCT lower(substr(p_name, 1, 2)) FROM part), f AS (SELECT CAST(p_partkey AS VARCHAR) AS id, lower(p_name) AS k, lower(p_name || ' ' || p_brand) AS k2, p_size FROM part), h AS (SELECT q, id, p_size FROM qs JOIN f ON contains(k, trim(q)) AND contains(k, q) OR contains(k2, q) WHERE length(q) > 0) SELECT q, id AS entity_id, CAST(o AS INT) AS ord FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY p_size DESC, id) AS o FROM h) WHERE o <= 50")
def contains_lookup(t):
    p = t("part")
    q = p.select(F.lower(F.substring("p_name", 3, 5)).alias("q")).union(p.select(F.lower(F.substring("p_name", 1, 2)))).distinct()
    return C.contains(q, part_kb(t))


BM = f"""{NAMES}, {{q}},
post AS (SELECT entity_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT entity_id, unnest(w) AS term, len(w) AS n FROM (SELECT entity_id, regexp_extract_all(lower(label), '([\\p{{{{L}}}}\\p{{{{N}}}}]+)') AS w FROM nm)) GROUP BY entity_id, term),
st AS (SELECT count(*) AS total, avg(n) AS mean FROM (SELECT DISTINCT entity_id, n FROM post)), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT q, entity_id, round(sum(2.0 * ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS s FROM want JOIN post USING (term) JOIN df USING (term), st GROUP BY q, entity_id)
SELECT q, entity_id, CAST(o AS INT) AS ord FROM (SELECT q, entity_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, entity_id) AS o FROM sc) WHERE o <= 50"""


@query("WITH " + BM.format(q="want AS (SELECT DISTINCT q, unnest(regexp_extract_all(q, '([\\p{L}\\p{N}]+)')) AS term FROM (SELECT DISTINCT lower(p_name) AS q FROM part))"))
def bm25_lookup(t):
    return C.full_text(t("part").select(F.lower("p_name").alias("q")).distinct(), names_kb(t))


#: Query terms as index terms within {1} edits or swaps; {0} are the queries.
NEAR = "voc AS (SELECT DISTINCT unnest(regexp_extract_all(lower(label), '([\\p{L}\\p{N}]+)')) AS v FROM nm), w0 AS (SELECT DISTINCT q, unnest(regexp_extract_all(q, '([\\p{L}\\p{N}]+)')) AS term FROM (SELECT DISTINCT {0} AS q FROM part)), near AS (SELECT term, v, row_number() OVER (PARTITION BY term ORDER BY damerau_levenshtein(term, v), v) AS k FROM (SELECT DISTINCT term FROM w0) JOIN voc ON substr(term, 1, 1) = substr(v, 1, 1) AND damerau_levenshtein(term, v) <= {1}), want AS (SELECT DISTINCT q, v AS term FROM w0 JOIN near USING (term) WHERE k <= 50)"


def near_sql(q: str, most: int) -> str:
    return "WITH " + BM.format(q=NEAR.replace("{0}", q).replace("{1}", str(most)))


@query(near_sql("lower(substr(p_name, 1, 1) || substr(p_name, 3))", 2))
def fuzzy_term_lookup(t):
    return C.full_text(_broken(t), names_kb(t), 2, 1)


@query(near_sql("lower(substr(p_name, 1, 1) || substr(p_name, 3, 1) || substr(p_name, 2, 1) || substr(p_name, 4))", 1))
def fuzzy_term_swapped(t):
    """Part names whose second and third characters have changed places: one edit, where swaps are edits."""
    n = F.col("p_name")
    swapped = F.concat(F.substring(n, 1, 1), F.substring(n, 3, 1), F.substring(n, 2, 1), n.substr(F.lit(4), F.length(n)))
    return C.full_text(t("part").select(F.lower(swapped).alias("q")).distinct(), names_kb(t), 1, 1)


FIELDS_SQL = r"""WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS entity_id, unnest(['label', 'aliases', 'description']) AS field, unnest([2.0, 1.5, 1.0]) AS boost, unnest([lower(p_name), lower(p_name || ' ' || p_brand), lower(p_type)]) AS v FROM part),
w AS (SELECT entity_id, field, boost, regexp_extract_all(v, '([\p{L}\p{N}]+)') AS w FROM f),
post AS (SELECT entity_id, field, boost, term, count(*) AS tf, any_value(n) AS n FROM (SELECT entity_id, field, boost, unnest(w) AS term, len(w) AS n FROM w) GROUP BY entity_id, field, boost, term),
st AS (SELECT field, count(*) AS total, avg(n) AS mean FROM (SELECT DISTINCT entity_id, field, n FROM post) GROUP BY field), df AS (SELECT field, term, count(*) AS df FROM post GROUP BY field, term),
want AS (SELECT DISTINCT q, unnest(regexp_extract_all(q, '([\p{L}\p{N}]+)')) AS term FROM (SELECT DISTINCT lower(p_type || ' ' || p_brand) AS q FROM part)),
sc AS (SELECT q, entity_id, round(max(s), 6) AS s FROM (SELECT q, entity_id, field, sum(boost * ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS s FROM want JOIN post USING (term) JOIN df USING (field, term) JOIN st USING (field) GROUP BY q, entity_id, field) GROUP BY q, entity_id)
SELECT q, entity_id, CAST(o AS INT) AS ord FROM (SELECT q, entity_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, entity_id) AS o FROM sc) WHERE o <= 50"""


@query(FIELDS_SQL)
def bm25_fields(t):
    """Labels, aliases and descriptions all hold terms; the best field counts."""
    return C.full_text(t("part").select(F.lower(F.concat_ws(" ", "p_type", "p_brand")).alias("q")).distinct(), part_kb(t))


@query("SELECT CAST(user_id AS VARCHAR) AS q, CAST(event_id AS VARCHAR) AS entity_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INT) AS ord FROM events WHERE ts + INTERVAL 3 DAY > TIMESTAMP '2024-01-10 00:00:00'")
def kv_cache_ttl(t):
    e = t("events")
    table = e.select(F.col("user_id").cast("string").alias("key"), F.to_json(F.struct(F.col("event_id").cast("string").alias("entity_id"))).alias("value"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("expires_at"), F.col("event_id").alias("load_ord"))
    return C.key_value(e.select(F.col("user_id").cast("string").alias("q")).distinct(), table, "2024-01-10 00:00:00")


def _two_layers(t, policy: str = "always") -> list[kb.Layer]:
    p = part_kb(t)
    return [kb.Layer("fast", "dict", 2, True, ["exact"], cache_policy=policy, records=p.filter("load_ord % 3 = 0")), kb.Layer("slow", "dict", 1, False, ["exact"], records=p)]


CHAIN = """qs AS (SELECT DISTINCT lower(p_name) AS q FROM part UNION SELECT DISTINCT lower(p_name || ' ' || p_brand) FROM part),
f AS (SELECT q, CAST(max(p_partkey) AS VARCHAR) AS id, 0 AS kind, 0 AS o, r FROM qs, (VALUES (0), (1)) v(r), part WHERE lower(p_name) = q AND (r = 1 OR p_partkey % 3 = 0) GROUP BY q, r
  UNION ALL SELECT q, CAST(p_partkey AS VARCHAR), 1, p_partkey, r FROM qs, (VALUES (0), (1)) v(r), part WHERE lower(p_name || ' ' || p_brand) = q AND (r = 1 OR p_partkey % 3 = 0)),
best AS (SELECT q, min(r) AS r FROM f GROUP BY q),
hits AS (SELECT q, id, r AS layer_rank, row_number() OVER (PARTITION BY q ORDER BY kind, o, id) AS ord FROM f JOIN best USING (q, r))"""


@query(f"WITH {CHAIN} SELECT q, id AS entity_id, CAST(ord AS INT) AS ord, CAST(layer_rank AS INT) AS layer_rank FROM hits")
def chain_first_layer_wins(t):
    return C.search_chain(_both_names(t), _two_layers(t))


def _writes(t, policy):
    q, layers = _both_names(t), _two_layers(t, policy)
    return C.cache_writes(q, C.search_chain(q, layers), layers).select("layer", "q", "entity_id", "ord")


@query(f"WITH {CHAIN} SELECT 'fast' AS layer, q, id AS entity_id, CAST(ord AS INT) AS ord FROM hits WHERE layer_rank > 0")
def cache_policy_always(t):
    return _writes(t, "always")


@query(f"WITH {CHAIN} SELECT 'fast' AS layer, q, id AS entity_id, CAST(ord AS INT) AS ord FROM hits WHERE layer_rank > 0")
def cache_policy_miss(t):
    return _writes(t, "miss")


# A layer that is asked for near matches alone, of long prefixes, misses aliases that an exact search of it would find.
@query("""WITH qs AS (SELECT DISTINCT lower(p_name) AS q FROM part UNION SELECT DISTINCT lower(p_name || ' ' || p_brand) FROM part),
late AS (SELECT q FROM qs WHERE q NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey % 3 = 0)),
f AS (SELECT q, CAST(max(p_partkey) AS VARCHAR) AS id, 0 AS kind, 0 AS o FROM late JOIN part ON lower(p_name) = q GROUP BY q UNION ALL SELECT q, CAST(p_partkey AS VARCHAR), 1, p_partkey FROM late JOIN part ON lower(p_name || ' ' || p_brand) = q)
SELECT 'fast' AS layer, q, id AS entity_id, CAST(row_number() OVER (PARTITION BY q ORDER BY kind, o, id) AS INT) AS ord FROM f WHERE q IN (SELECT lower(p_name || ' ' || p_brand) FROM part WHERE p_partkey % 3 = 0)""")
def cache_policy_hit(t):
    q, layers = _both_names(t), _two_layers(t, "hit")
    layers[0].search_mode, layers[0].fuzzy = ["fuzzy"], {"min_similarity": 1.0, "prefix_length": 60}
    return C.cache_writes(q, C.search_chain(q, layers), layers).select("layer", "q", "entity_id", "ord")


@query("""WITH qs AS (SELECT DISTINCT lower(p_name || ' ' || p_brand) AS q FROM part),
f AS (SELECT q, p_partkey AS id, CASE p_partkey % 3 WHEN 2 THEN 2 ELSE p_partkey % 3 END AS own FROM qs JOIN part ON lower(p_name || ' ' || p_brand) = q),
r AS (SELECT q, CASE WHEN bool_or(own = 0) THEN 0 WHEN bool_or(own = 1) THEN 1 ELSE 2 END AS r FROM f GROUP BY q),
h AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY id) AS ord FROM f JOIN r USING (q) WHERE r = 2)
SELECT layer, q, CAST(id AS VARCHAR) AS entity_id, CAST(ord AS INT) AS ord FROM h, (VALUES ('a'), ('b')) v(layer)""")
def cache_equal_priorities(t):
    """Of three layers the upper two have one priority: neither receives what the other answers."""
    p = part_kb(t)
    layers = [kb.Layer("a", priority=2, records=p.filter("load_ord % 3 = 0")), kb.Layer("b", priority=2, records=p.filter("load_ord % 3 = 1")), kb.Layer("c", priority=1, write=False, records=p)]
    q = p.select(F.lower(F.col("aliases")[0]).alias("q")).distinct()
    return C.cache_writes(q, C.search_chain(q, layers), layers).select("layer", "q", "entity_id", "ord")


@query(f"""WITH {CHAIN}, got AS (SELECT DISTINCT id FROM hits WHERE layer_rank = 1),
two AS (SELECT p_partkey, lower(p_name) AS k, lower(p_name || ' ' || p_brand) AS k2, CASE WHEN id IS NOT NULL THEN 17592186044416 + p_partkey ELSE p_partkey END AS o FROM part LEFT JOIN got ON id = CAST(p_partkey AS VARCHAR) WHERE p_partkey % 3 = 0 OR id IS NOT NULL),
f2 AS (SELECT q, arg_max(p_partkey, o) AS id, 0 AS kind, 0::BIGINT AS o FROM qs JOIN two ON k = q GROUP BY q UNION ALL SELECT q, p_partkey, 1, o FROM qs JOIN two ON k2 = q)
SELECT q, CAST(id AS VARCHAR) AS entity_id, CAST(row_number() OVER (PARTITION BY q ORDER BY kind, o, CAST(id AS VARCHAR)) AS INT) AS ord, CAST(0 AS INT) AS layer_rank FROM f2""")
def cache_second_search(t):
    """What a lower layer has answered once the upper one answers the next time."""
    q, chain = _both_names(t), kb.Chain(_two_layers(t))
    C.write_back(q, C.search_chain(q, chain.usable()), chain)
    return C.search_chain(q, chain.usable()).select("q", "entity_id", "ord", "layer_rank")


@query("WITH pop AS (SELECT l_partkey, count(*) AS pop FROM lineitem GROUP BY l_partkey), c AS (SELECT l_orderkey AS t, l_partkey AS id, l_linenumber AS o, pop FROM lineitem JOIN pop USING (l_partkey) WHERE pop >= 25), d AS (SELECT t, id, min(o) AS o, any_value(pop) AS pop FROM c GROUP BY t, id), k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY o, CAST(id AS VARCHAR)) AS r FROM d) SELECT t AS text_idx, CAST(id AS VARCHAR) AS entity_id, CAST(row_number() OVER (PARTITION BY t ORDER BY pop DESC, o, CAST(id AS VARCHAR)) AS INT) AS cand_ord FROM k WHERE r <= 3")
def cand_filter_dedup_limit_sort(t):
    li = t("lineitem")
    pop = li.groupBy("l_partkey").agg(F.count("*").alias("popularity"))
    c = li.join(pop, "l_partkey").select(F.col("l_orderkey").alias("text_idx"), F.lit(0).alias("mention_idx"), F.col("l_partkey").cast("string").alias("entity_id"), F.col("l_linenumber").alias("ord"), "popularity")
    return C.sort_by_popularity(C.limit_candidates(C.deduplicate_candidates(C.filter_by_popularity(c, 25)), 3)).select("text_idx", "entity_id", "cand_ord")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS entity_id, r_name AS label, CAST(NULL AS BIGINT) AS text_idx, CAST(r_regionkey AS BIGINT) AS cand_ord FROM region")
def all_entities_mode(t):
    """Without mentions all records are every text's candidates, as one list that texts share."""
    r = t("region").select(F.col("r_regionkey").cast("string").alias("entity_id"), F.col("r_name").alias("label"), F.col("r_regionkey").cast("long").alias("load_ord"))
    return C.all_entities(r).select("entity_id", "label", "text_idx", "cand_ord")


@query("SELECT CAST(id AS VARCHAR) AS entity_id, CAST(pop AS BIGINT) AS popularity FROM (SELECT p_partkey AS id, p_size AS pop FROM part) ORDER BY pop DESC, CAST(id AS VARCHAR) LIMIT 50")
def unique_candidates(t):
    """A report of the most popular candidates, each once, over links of line items."""
    p = part_kb(t).withColumn("cand_ord", F.lit(1)).withColumn("mention_idx", F.lit(0))
    twice = p.withColumn("text_idx", F.lit(0).cast("long")).unionByName(p.withColumn("text_idx", F.lit(1).cast("long")))
    return C.unique_candidates(twice, 50).select("entity_id", "popularity")


# --- L3 and L4 --------------------------------------------------------------------------------

def _part_candidates(t) -> DataFrame:
    p = part_kb(t)
    return p.select(F.col("popularity").alias("text_idx"), F.lit(0).alias("mention_idx"), F.col("load_ord").alias("cand_ord"), "entity_id", "label", "aliases", "description", "popularity",
                    F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model_id"))


@query("SELECT CAST(p_size AS BIGINT) AS text_idx, lower(p_name || ': ' || p_type) AS label_text, CAST(min(p_partkey) AS VARCHAR) AS entity_id FROM part GROUP BY p_size, lower(p_name || ': ' || p_type)")
def label_template_dedup(t):
    return L.labels(_part_candidates(t), "{label}: {description}").select("text_idx", F.lower("label_text").alias("label_text"), "entity_id")


@query("WITH a AS (SELECT p_size, lower(p_name) AS l, min(p_partkey) AS k FROM part GROUP BY p_size, lower(p_name)), b AS (SELECT p_size, k, row_number() OVER (PARTITION BY p_size ORDER BY k) - 1 AS i FROM a) SELECT CAST(p_size AS BIGINT) AS text_idx, CAST(i // 20 AS INT) AS chunk, CAST(count(*) AS INT) AS n_labels FROM b GROUP BY ALL")
def l4_chunks(t):
    return L.chunks(L.labels(_part_candidates(t)), 20).select("text_idx", "chunk", F.size("labels").alias("n_labels"))


LINE = "li AS (SELECT l_orderkey AS text_idx, CAST(l_linenumber AS BIGINT) * 1000000000000 + CAST(l_partkey AS BIGINT) * 100000 + l_suppkey AS link_ord, l_returnflag AS text, CAST(l_linenumber % 3 AS INT) AS b, CAST(l_linenumber % 3 + 4 AS INT) AS e, l_discount * 10 AS score FROM lineitem)"


def _lines(t) -> DataFrame:
    b = (F.col("l_linenumber") % 3).cast("int")
    return t("lineitem").select(F.col("l_orderkey").alias("text_idx"), (F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey").cast("long") * 100000 + F.col("l_suppkey")).alias("link_ord"), F.col("l_returnflag").alias("text"), F.col("l_linestatus").alias("label"),
                                b.alias("start"), (b + 4).alias("end"), (F.col("l_discount") * 10).alias("score"))


@query(f"WITH {LINE} SELECT text_idx, row_number() OVER (PARTITION BY text_idx ORDER BY b, link_ord) AS link_ord, b AS start_pos, score FROM li WHERE score >= 0.35")
def l3_filter_sort(t):
    return L.sort_by_position(L.filter_by_score(_lines(t), 0.35)).select("text_idx", "link_ord", F.col("start").alias("start_pos"), "score")


@query(f"WITH {LINE} SELECT text_idx, text, b AS start_pos, arg_min(score, link_ord) AS score FROM li GROUP BY text_idx, text, b, e")
def l3_dedup_first(t):
    return L.deduplicate_links(_lines(t)).select("text_idx", "text", F.col("start").alias("start_pos"), "score")


@query(f"WITH {LINE} SELECT text_idx, text, b AS start_pos, max(score) AS score, min(link_ord) AS link_ord FROM li GROUP BY text_idx, text, b, e")
def l4_dedup_max(t):
    return L.deduplicate_best(_lines(t)).select("text_idx", "text", F.col("start").alias("start_pos"), "score", "link_ord")


@query("WITH f AS (SELECT p_size, p_name, arg_max(p_partkey * 37 % 101, p_partkey) AS pop FROM part GROUP BY p_size, p_name) SELECT CAST(p_partkey AS BIGINT) AS link_id, round((0.7 * (p_partkey % 10) / 10.0 + 0.3 * least(coalesce(pop, 0) * 20000 / 1e6, 1.0)) / 1.0, 9) AS score FROM part p LEFT JOIN f ON f.p_size = p.p_size AND f.p_name = CASE WHEN p_partkey % 5 = 0 THEN 'no such' ELSE p.p_name END")
def rank_weighted(t):
    """The last candidate of a label gives the popularity; a label without a candidate counts as 0."""
    c = _part_candidates(t).withColumn("popularity", F.col("entity_id").cast("long") * 37 % 101 * 20000)
    li = t("part").select(F.col("p_size").cast("long").alias("text_idx"), F.col("p_partkey").alias("link_ord"), F.col("p_name").alias("text"), F.when(F.col("p_partkey") % 5 == 0, "no such").otherwise(F.col("p_name")).alias("label"),
                          F.col("p_partkey").cast("int").alias("start"), F.lit(0).alias("end"), (F.col("p_partkey") % 10 / 10.0).alias("score"))
    return L.rank(li, c, [("gliner_score", 0.7), ("popularity", 0.3)]).select(F.col("start").cast("long").alias("link_id"), F.round("score", 9).alias("score"))


@query("SELECT CAST(vec_id // 10 AS BIGINT) AS text_idx, bool_and(vec_id % 13 <> 0 AND label < 8) AS eligible FROM embeddings GROUP BY vec_id // 10")
def precomputed_eligible(t):
    e = t("embeddings").select(F.floor(F.col("vec_id") / 10).alias("text_idx"), F.when(F.col("vec_id") % 13 != 0, F.col("embedding")).alias("embedding"), F.when(F.col("label") < 8, "m").otherwise("x").alias("embedding_model_id"))
    return L.precomputed_eligible(e, "m")


VEC = "v AS (SELECT vec_id, vec_id // 10 AS text_idx, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), c AS (SELECT text_idx, label, arg_min(x, vec_id) AS y FROM v GROUP BY text_idx, label)"


def _vectors(t) -> tuple[DataFrame, DataFrame]:
    """Vectors as mentions, ten to a text, and each text's labels as candidates with the vector of their first row."""
    e = t("embeddings").withColumn("text_idx", F.floor(F.col("vec_id") / 10))
    m = e.select("text_idx", F.lit("").alias("text"), F.col("vec_id").cast("int").alias("start"), (F.col("vec_id") + 1).cast("int").alias("end"), F.col("embedding").alias("vector"))
    c = e.groupBy("text_idx", "label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(
        "text_idx", F.lit(0).alias("mention_idx"), F.col("label").alias("cand_ord"), F.col("label").cast("string").alias("entity_id"), F.col("label").cast("string").alias("label"), F.array().cast("array<string>").alias("aliases"),
        F.lit(0).cast("long").alias("popularity"), "embedding", F.when(F.col("label") < 8, "m").otherwise("x").alias("embedding_model_id"))
    return m, c


@query(f"WITH {VEC} SELECT vec_id, CAST(c.label AS VARCHAR) AS label, round(1 / (1 + exp(-list_dot_product(x, y))), 6) AS score FROM v JOIN c USING (text_idx)")
def bi_encoder_score(t):
    m, c = _vectors(t)
    got = L.bi_encoder(m, L.labels(c), threshold=0.0, multi_label=True, flat=False)
    return got.select(F.col("start").cast("long").alias("vec_id"), "label", F.round("score", 6).alias("score"))


@query(f"WITH {VEC}, ok AS (SELECT text_idx, bool_and(label < 8) AS ok FROM c GROUP BY text_idx) SELECT vec_id, CAST(c.label AS VARCHAR) AS label, round(1 / (1 + exp(-CASE WHEN ok THEN list_dot_product(x, y) ELSE x[c.label + 1] END)), 6) AS score FROM v JOIN c USING (text_idx) JOIN ok USING (text_idx)")
def l3_precomputed(t):
    """Candidates' own vectors, or, in texts where one has none of the model, vectors made on the fly."""
    m, c = _vectors(t)
    unit = lambda x: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == x.cast("int"), 1.0).otherwise(0.0))
    got = L.bi_encoder_links(m, c, L.labels(c), "m", unit, threshold=0.0, multi_label=True, flat=False)
    return got.select(F.col("start").cast("long").alias("vec_id"), "label", F.round("score", 6).alias("score"))


# Names that texts of several languages mention: an entity for each language, described by that language's most
# frequent words. Weights are by a rule, so SQL can say the scorer's forward pass.
SENSES = MEN + r""",
vocab AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM (SELECT lang, lower(tok) AS word, count(*) AS n FROM tok JOIN documents USING (doc_id) WHERE regexp_matches(tok, '^\p{L}') GROUP BY ALL)),
named AS (SELECT DISTINCT lower(m.text) AS key, lang FROM m JOIN documents d ON d.doc_id = m.text_idx),
senses AS (SELECT key, lang, row_number() OVER (PARTITION BY key ORDER BY lang) AS ord, count(*) OVER (PARTITION BY key) AS n FROM named),
pairs AS (SELECT m.text_idx, m.mention_idx, s.lang, s.ord, lower(trim(substr(d.text, greatest(b - 50, 0) + 1, least(b, 50)), E' \n\t\r') || ' ' || trim(substr(d.text, e + 1, 50), E' \n\t\r')) AS around
  FROM m JOIN documents d ON d.doc_id = m.text_idx JOIN senses s ON s.key = lower(m.text) AND s.n > 1),
crc_table AS (SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
men AS (SELECT DISTINCT text_idx, mention_idx, around FROM pairs),
near AS (SELECT DISTINCT text_idx, mention_idx, unnest(regexp_extract_all(around, '([\p{L}\p{N}]+)')) AS word FROM men),
every AS (SELECT DISTINCT word FROM near UNION SELECT word FROM vocab WHERE k <= 8),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: CAST(strpos('0123456789ABCDEF', left(x, 1)) * 16 + strpos('0123456789ABCDEF', right(x, 1)) - 17 AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM every, crc_table),
about AS (SELECT lang, h FROM vocab JOIN crc USING (word) WHERE k <= 8),
around AS (SELECT text_idx, mention_idx, h FROM near JOIN crc USING (word)),
w AS (SELECT text_idx, mention_idx, lang, sum(weight(16 + (a.h * 31 + b.h * 17) % 65520)) / sqrt(count(*)) AS z, count_if(a.h = b.h) AS met FROM pairs JOIN around a USING (text_idx, mention_idx) JOIN about b USING (lang) GROUP BY ALL),
zs AS (SELECT p.text_idx, p.mention_idx, p.lang, ord, coalesce(z, 0) + weight(0) + weight(1) + CASE WHEN met > 0 THEN weight(2) ELSE 0 END + weight(3 + 10 * coalesce(met, 0) // 8) AS z FROM pairs p LEFT JOIN w USING (text_idx, mention_idx, lang)),
best AS (SELECT text_idx, mention_idx, count(*) AS n_labels, arg_max(lang, z - ord * 1e-9) AS lang, max(1 / (1 + exp(-z))) AS score FROM zs GROUP BY text_idx, mention_idx)"""
SENSES = re.sub(r"weight\(((?:[^()]|\([^()]*\))*)\)", r"((((\1) * 7919) % 2001 - 1000) / 4000.0)", SENSES)
RULE = ((np.arange(scorer.BUCKETS) * 7919) % 2001 - 1000) / 4000.0


def sense_pairs(t, words: int = 8) -> tuple[DataFrame, DataFrame]:
    """Mentions of names that several languages have, each as a text of its own, and the languages as candidates."""
    m, docs = cut(_mentions(t)), t("documents").select(F.col("doc_id").alias("text_idx"), "lang")
    tokens = M.tokens(_texts(t)).filter(F.col("token").rlike(r"^\p{L}")).join(docs, "text_idx").groupBy("lang", F.lower("token").alias("word")).agg(F.count("*").alias("n"))
    top = top_k(tokens, ["lang"], words, F.col("n").desc(), "word").groupBy("lang").agg(F.concat_ws(" ", F.collect_list("word")).alias("description"))
    key = m.withColumn("key", F.lower("text"))
    named = key.join(docs, "text_idx").select("key", "lang").distinct()
    langs = named.groupBy("key").agg(F.array_sort(F.collect_set("lang")).alias("langs")).filter(F.size("langs") > 1)
    key = key.join(langs, "key").withColumn("text_idx", F.col("text_idx") * 1_000_000 + F.col("mention_idx"))
    c = key.select("text_idx", "mention_idx", "key", F.posexplode("langs").alias("cand_ord", "lang")).join(top, "lang")
    c = c.select("text_idx", "mention_idx", "cand_ord", F.concat_ws("|", "key", "lang").alias("entity_id"), F.col("key").alias("label"), F.array().cast("array<string>").alias("aliases"), "description", F.col("lang").alias("entity_type"),
                 F.lit(0).cast("long").alias("popularity"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model_id"))
    return key.drop("key", "langs"), c


@query(f"WITH {SENSES} SELECT text_idx, mention_idx, lang, n_labels, round(score, 6) AS score FROM best")
def context_score(t):
    """The forward pass of the context scorer: which language's sense of a name its surroundings suit best."""
    m, c = sense_pairs(t)
    got = scorer.context_links(m, L.labels(c, "{entity_type}"), RULE, threshold=0.0, flat=False)
    at = F.col("text_idx")
    return got.select(F.floor(at / 1_000_000).alias("text_idx"), (at % 1_000_000).alias("mention_idx"), F.col("label").alias("lang"), F.size("class_probs").cast("long").alias("n_labels"), F.round("score", 6).alias("score"))


# --- L0 ---------------------------------------------------------------------------------------

@query(f"WITH {AGG} SELECT text_idx, mention_idx, text AS mention_text, num_candidates, is_linked, entity_id, confidence, lb AS linked_start, le AS linked_end, stage FROM staged")
def l0_aggregate(t):
    return _linked(t).select("text_idx", "mention_idx", "mention_text", "num_candidates", "is_linked", "entity_id", "confidence", "linked_start", "linked_end", "stage")


@query(f"WITH {AGG} SELECT i.text_idx, i.b AS start_pos, i.e AS end_pos, i.score AS confidence, 'l3_only' AS stage FROM idx i WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE s.text_idx = i.text_idx AND s.lb = i.b AND s.le = i.e)")
def l0_loose(t):
    return _linked(t, False).filter("stage = 'l3_only'").select("text_idx", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "confidence", "stage")


@query(f"WITH {AGG} SELECT text_idx, mention_idx FROM staged WHERE is_linked AND confidence >= 0.5")
def l0_filter_confidence(t):
    return A.filter_by_confidence(_linked(t), 0.5, False).select("text_idx", "mention_idx")


@query(f"WITH {AGG} SELECT text_idx, mention_idx, CAST(row_number() OVER (PARTITION BY text_idx ORDER BY coalesce(confidence, 0.0) DESC, mention_idx) AS INT) AS out_ord FROM staged")
def l0_sort(t):
    return A.sort_by_confidence(_linked(t)).select("text_idx", "mention_idx", "out_ord")


@query(f"WITH {AGG} SELECT count(*) AS total_mentions, count_if(is_linked)::BIGINT AS linked, count_if(NOT is_linked)::BIGINT AS unlinked, count_if(is_linked) / count(*) AS linking_rate, count_if(stage = 'l1_only')::BIGINT AS l1_only, count_if(stage = 'l2_found')::BIGINT AS l2_found, count_if(stage = 'l3_linked')::BIGINT AS l3_linked, 0::BIGINT AS l3_only FROM staged")
def l0_stats(t):
    return A.calculate_stats(_linked(t))


# Each link's label is found by either pass: a candidate of that label, else one whose label lies within it.
@query(f"""WITH {KB},
cand AS (SELECT m.text_idx, m.mention_idx AS occ, kb.entity_id, kb.label FROM m JOIN kb ON lower(m.text) = kb.label OR lower(m.text) = kb.alias),
p AS (SELECT text_idx, mention_idx, b, lower(text) AS want FROM m),
same AS (SELECT p.text_idx, p.mention_idx, min(c.entity_id) AS entity_id FROM p JOIN cand c ON c.text_idx = p.text_idx AND c.label = p.want GROUP BY ALL),
part AS (SELECT p.text_idx, p.mention_idx, arg_min(c.entity_id, c.occ * 10000 + length(c.entity_id)) AS entity_id FROM p JOIN cand c ON c.text_idx = p.text_idx AND contains(p.want, c.label) GROUP BY ALL)
SELECT p.text_idx, p.b AS start_pos, coalesce(same.entity_id, part.entity_id) AS entity_id, CAST((p.mention_idx % 5) / 5.0 AS DOUBLE) AS p
FROM p LEFT JOIN same USING (text_idx, mention_idx) LEFT JOIN part USING (text_idx, mention_idx) WHERE coalesce(same.entity_id, part.entity_id) IS NOT NULL""")
def l0_candidate_scores(t):
    m = cut(_mentions(t))
    k = cut(corpus_kb(m))
    c = C.candidates(m, kb.Chain([kb.Layer("terms", "dict", records=k)]), 30, 0)
    li = m.select("text_idx", "start", "end", F.create_map(F.lower("text"), F.col("mention_idx") % 5 / 5.0).alias("class_probs"))
    return A.candidate_scores(li, c).select("text_idx", F.col("start").alias("start_pos"), F.explode("scores").alias("entity_id", "p"))


@query(f"WITH {agg_sql(0)} SELECT text_idx, mention_idx, is_linked, lb AS linked_start FROM staged")
def l0_exact_position(t):
    return _linked(t, tolerance=0).select("text_idx", "mention_idx", "is_linked", "linked_start")


@query(f"WITH {agg_sql(3)} SELECT text_idx, mention_idx, is_linked, lb AS linked_start, le AS linked_end FROM staged")
def l0_tolerance(t):
    return _linked(t, tolerance=3).select("text_idx", "mention_idx", "is_linked", "linked_start", "linked_end")


@query(f"WITH {agg_sql(2, ' (term)')} SELECT text_idx, mention_idx, entity_id FROM staged WHERE is_linked")
def l0_template_match(t):
    return _linked(t, kind=" (term)").filter("is_linked").select("text_idx", "mention_idx", "entity_id")


@query(f"WITH {AGG} SELECT text_idx, stage, count(*) AS n FROM staged GROUP BY text_idx, stage")
def l0_stage(t):
    return _linked(t).groupBy("text_idx", "stage").agg(F.count("*").alias("n"))


@query(f"WITH {AGG} SELECT count(*) AS total_mentions, count_if(is_linked)::BIGINT AS linked, count_if(NOT is_linked)::BIGINT AS unlinked, round(count_if(is_linked) / count(*), 9) AS linking_rate FROM staged")
def l0_stats_rolled_up(t):
    """Statistics of each text added up."""
    return A.roll_up(A.calculate_stats(_linked(t), "text_idx")).withColumn("linking_rate", F.round("linking_rate", 9))


# --- plan language ----------------------------------------------------------------------------

def _talks(t) -> DataFrame:
    return t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn, role, text) AS roles FROM conversations GROUP BY conv_id")
def path_field_of_all(t):
    d = _talks(t)
    return d.select("conv_id", F.array_join(paths.path_column(d.schema, "turns[*].role"), ",").alias("roles"))


@query("SELECT conv_id, x[2].t AS second, x[-1].t AS last, array_to_string([y.r FOR y IN x[2:3]], ',') AS part FROM (SELECT conv_id, list({'t': text, 'r': role} ORDER BY turn, role, text) AS x FROM conversations GROUP BY conv_id)")
def path_index_and_slice(t):
    d = _talks(t)
    p = lambda x: paths.path_column(d.schema, x)
    return d.select("conv_id", p("turns[1].text").alias("second"), p("turns[-1].text").alias("last"), F.array_join(p("turns[1:3].role"), ",").alias("part"))


@query("SELECT conv_id, arg_min(text, turn) AS first_text FROM conversations GROUP BY conv_id")
def reduce_first(t):
    d = _talks(t)
    return d.select("conv_id", paths.reduce_column(paths.path_column(d.schema, "turns[*].text"), "first").alias("first_text"))


@query("SELECT conv_id, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id")
def reduce_last(t):
    d = _talks(t)
    return d.select("conv_id", paths.reduce_column(paths.path_column(d.schema, "turns[*].text"), "last").alias("last_text"))


@query("SELECT conv_id, count(*) AS n, CAST(sum(length(role)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def reduce_all(t):
    """Lists of lists made one."""
    d = _talks(t).select("conv_id", F.transform("turns", lambda x: F.array(x)).alias("groups"))
    flat = paths.reduce_column(paths.path_column(d.schema, "groups[*][*].role"), "all", 2)
    return d.select("conv_id", F.size(flat).cast("long").alias("n"), F.length(F.array_join(flat, "")).cast("long").alias("n_chars"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice >= 150000.5 AND o_orderstatus <> 'O'")
def filter_expression(t):
    return paths.filter_frame(paths.filter_frame(t("orders"), "o_totalprice >= 150000.5"), "o_orderstatus != 'O'").select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_name || ' (' || c_mktsegment || ') {' || CAST(c_nationkey AS VARCHAR) || '}' AS label FROM customer")
def template_column(t):
    c = t("customer")
    return c.select("c_custkey", template("{c_name} ({c_mktsegment}) {{{c_nationkey}}}", c.columns, "c_name").alias("label"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'EXISTING' ELSE 'NEW' END AS status, CASE WHEN c_nationkey >= 5 THEN CASE c_mktsegment WHEN 'BUILDING' THEN 'DOCTORS' WHEN 'MACHINERY' THEN 'PATIENTS' ELSE 'DISEASES' END END AS target_table FROM customer")
def clinical_routing(t):
    rows = t("customer").select("c_custkey", (F.col("c_nationkey") < 5).alias("is_linked"), F.col("c_mktsegment").alias("label"))
    return A.route(rows, {"BUILDING": "DOCTORS", "MACHINERY": "PATIENTS"}).select("c_custkey", "status", "target_table")


# --- pipelines --------------------------------------------------------------------------------

@query(f"WITH {KB} SELECT d.lang, count(*) AS total_mentions, count(kb.label) AS linked, count(*) - count(kb.label) AS unlinked, count(DISTINCT m.text_idx) AS docs FROM m JOIN documents d ON d.doc_id = m.text_idx LEFT JOIN kb ON kb.label = lower(m.text) GROUP BY d.lang")
def corpus_linking(t):
    """Which terms of the corpus's own knowledge base each document mentions, by language."""
    m = cut(_mentions(t))
    k = cut(corpus_kb(m))
    hits = C.exact(C.queries_of(m), k).filter("ord = 1").join(k.select("entity_id", "label"), "entity_id").filter("q = label")
    rows = m.withColumn("q", F.lower("text")).join(hits.select("q", "entity_id"), "q", "left").join(t("documents").select(F.col("doc_id").alias("text_idx"), "lang"), "text_idx")
    return rows.groupBy("lang").agg(F.count("*").alias("total_mentions"), F.count("entity_id").alias("linked"), (F.count("*") - F.count("entity_id")).alias("unlinked"), F.countDistinct("text_idx").alias("docs"))


def _nations(t) -> tuple[DataFrame, DataFrame]:
    """Sentences about suppliers and nations, and the nations and regions as records."""
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    texts = s.select(F.col("s_suppkey").alias("text_idx"), F.concat(F.lit("A supplier from "), "n_name", F.lit(" ships widely.")).alias("text"))
    recs = t("nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("long").alias("load_ord"), F.lit(1).alias("popularity"))
    return texts, recs


E2E = "SELECT s_suppkey AS text_idx, n_name AS mention_text, 'N' || CAST(n_nationkey AS VARCHAR) AS entity_id, true AS is_linked, 1.0::DOUBLE AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def _given(texts: DataFrame) -> DataFrame:
    at = F.length(F.lit("A supplier from "))
    span = texts.select("text_idx", F.regexp_extract("text", "^A supplier from (.*) ships widely", 1).alias("text"))
    return M.external_mentions(span.withColumn("mention_idx", F.lit(0).cast("long")).withColumn("start", at).withColumn("end", at + F.length("text")))


@query(E2E)
def e2e_external(t):
    """Mentions given with the texts."""
    texts, recs = _nations(t)
    ex = Factory.create_simple(texts.sparkSession, entities=recs, external_entities=True, threshold=0.95)
    out = ex.execute({"texts": texts, "entities": _given(texts)}).get("l0_result")
    return out.filter("is_linked").select("text_idx", "mention_text", "entity_id", "is_linked", "confidence")


@query(E2E)
def e2e_rerank(t):
    """L3, then L4 over chunks of one label each; near names are candidates too."""
    texts, recs = _nations(t)
    b = ConfigBuilder("rerank").set_schema_template("{label}")
    b.l2.add("dict", fuzzy_similarity=0.6).l3.configure(threshold=0.5).l4.configure(threshold=0.95, max_labels=1)
    ex = Factory.create_from_dict(b.build(), texts.sparkSession)
    ex.load_entities(recs)
    out = ex.execute({"texts": texts, "entities": _given(texts)}).get("l0_result")
    return out.filter("is_linked").select("text_idx", "mention_text", "entity_id", "is_linked", "confidence")


@query(E2E)
def e2e_full(t):
    """L1 to L0: names of the knowledge base are found in the texts, looked up and linked."""
    texts, recs = _nations(t)
    b = ConfigBuilder("full").set_schema_template("{label}").l1.spacy().l3.configure(threshold=0.95)
    ex = Factory.create_from_dict(b.build(), texts.sparkSession)
    ex.load_entities(recs)
    out = ex.execute({"texts": texts}).get("l0_result")
    return out.filter("is_linked").select("text_idx", "mention_text", "entity_id", "is_linked", "confidence")


@query("SELECT s_suppkey AS text_idx, n_name AS mention_text, 'N' || CAST(n_nationkey AS VARCHAR) AS entity_id, 'l3_only' AS stage, CAST(16 AS INT) AS start_pos FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def e2e_simple(t):
    """Texts alone: all entities are every text's candidates, and links are found without mentions."""
    texts, recs = _nations(t)
    out = Factory.create_simple(texts.sparkSession, entities=recs).execute({"texts": texts}).get("l0_result")
    return out.select("text_idx", "mention_text", "entity_id", "stage", F.col("start").alias("start_pos"))


def _places(t) -> tuple[DataFrame, DataFrame]:
    """Sentences about customers, and nations and regions as records whose names lie within each other."""
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    long = F.concat("n_name", F.lit(" of "), "r_name", F.lit(" (no. "), F.col("n_nationkey").cast("string"), F.lit(")"))
    texts = c.select(F.col("c_custkey").alias("text_idx"), F.concat(F.lit("Sold to "), F.when(F.col("c_custkey") % 2 == 0, long).otherwise(F.col("n_name")), F.lit(", then over "), "r_name", F.lit("!")).alias("text"))
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    recs = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.col("n_name").alias("label"), F.array(long).alias("aliases"), (F.col("n_nationkey") * 50_000).cast("long").alias("popularity"), F.col("n_nationkey").cast("long").alias("load_ord"))
    recs = recs.unionByName(t("region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("entity_id"), F.col("r_name").alias("label"), F.array().cast("array<string>").alias("aliases"), F.lit(900_000).cast("long").alias("popularity"), (F.col("r_regionkey") + 100).cast("long").alias("load_ord")))
    return texts, recs


PLACES = """p AS (SELECT c_custkey, n_name, r_name, CAST(n_nationkey AS VARCHAR) AS n, CAST(r_regionkey AS VARCHAR) AS r, n_nationkey, 'Sold to ' || CASE WHEN c_custkey % 2 = 0 THEN n_name || ' of ' || r_name || ' (no. ' || n_nationkey || ')' ELSE n_name END AS head
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
found AS (SELECT c_custkey AS text_idx, substr(head, 9) AS text, n_name AS label, CAST(8 AS INT) AS start_pos, 'N' || n AS entity_id, n_nationkey * 50000 AS popularity FROM p
  UNION ALL SELECT c_custkey, r_name, r_name, CAST(length(head) + 12 AS INT), 'R' || r, 900000 FROM p)"""


@query(f"""WITH {PLACES} SELECT * EXCLUDE (popularity, entity_id) FROM found UNION ALL
SELECT c_custkey, n_name, n_name, CAST(8 AS INT) FROM p WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, r_name, r_name, CAST(length('Sold to ' || n_name || ' of ') AS INT) FROM p WHERE c_custkey % 2 = 0""")
def shared_links_overlapping(t):
    """Candidates that all texts share: every name that stands in a text, also within a longer one."""
    texts, recs = _places(t)
    got = L.shared_links(texts, C.all_entities(kb._complete(recs)), flat=False)
    return got.select("text_idx", "text", "label", F.col("start").alias("start_pos"))


@query(f"WITH {PLACES} SELECT text_idx, text AS mention_text, entity_id, start_pos, round(0.25 + 0.75 * least(popularity / 1e6, 1.0), 9) AS confidence FROM found")
def e2e_shared_ranked(t):
    """Texts alone, with the default that forbids overlaps, and links ranked by score and popularity."""
    texts, recs = _places(t)
    b = ConfigBuilder("shared").set_schema_template("{label}").set_ranking([{"field": "gliner_score", "weight": 0.25}, {"field": "popularity", "weight": 0.75}])
    b.l2.add("dict").l3.configure(threshold=0.5).l0.configure(strict_matching=False)
    ex = Factory.create_from_dict(b.build(), texts.sparkSession)
    ex.load_entities(recs)
    out = ex.execute({"texts": texts}).get("l0_result")
    return out.select("text_idx", "mention_text", "entity_id", F.col("start").alias("start_pos"), F.round("confidence", 9).alias("confidence"))
