"""Path language, filters, plans and builders."""

import pytest
from linkloom.functions import paths
from linkloom.plans import dag, processors, registry
from linkloom.plans.builder import ConfigBuilder, Factory
from linkloom.schema import template
from pyspark.sql import functions as F


@pytest.mark.parametrize("data, path, want", [
    ({"texts": ["hello", "world"]}, "texts", ["hello", "world"]), ({"items": ["a", "b", "c"]}, "items[0]", "a"), ({"items": [1, 2]}, "items[-1]", 2),
    ({"items": [{"name": "a"}, {"name": "b"}]}, "items[*].name", ["a", "b"]), ({"items": [1, 2, 3, 4, 5]}, "items[1:3]", [2, 3]),
    ({"outer": [[{"x": 1}, {"x": 2}], [{"x": 3}]]}, "outer[*][*].x", [[1, 2], [3]]), ({"a": None}, "a.b", None)])
def test_paths(data, path, want):
    assert paths.resolve(data, path) == want


def test_filters_and_reduce():
    rows = [{"s": 0.9}, {"s": 0.2}, {"s": None}, {"s": "x"}]
    assert paths.filter_values(rows, "s > 0.5") == [{"s": 0.9}]
    assert paths.filter_values(rows, "nonsense") == rows
    assert paths.reduce_values([[1], [2, [3]]], "all") == [1, 2, 3]
    assert paths.reduce_values([], "first") is None
    assert paths.format_values([{"a": 1}, {"b": 2}], "{a}!") == ["1!", "{'b': 2}"]


def test_template(spark):
    df = spark.createDataFrame([("x", 1)], "label string, n int")
    assert df.select(template("{label}-{n}{{}}", df.columns)).first()[0] == "x-1{}"
    assert df.select(template("{gone}", df.columns)).first()[0] == "x"
    with pytest.raises(ValueError):
        template("{n:>5}", df.columns)


def test_levels():
    node = lambda i, src, req=(): dag.Node(i, "p", {"x": dag.Input(src)}, f"{i}_result", None, list(req))
    assert dag.levels([node("a", "$input"), node("b", "a_result"), node("c", "$input"), node("d", "b", ["c"])]) == [["a", "c"], ["b"], ["d"]]
    with pytest.raises(ValueError, match="cycle"):
        dag.levels([node("a", "b"), node("b", "a")])
    with pytest.raises(ValueError, match="unknown"):
        dag.levels([node("a", "$input", ["z"])])


def test_context():
    c = dag.Context({"texts": []})
    c.set("a", [1])
    c.set("b", [2])
    assert (c.get("outputs[-1]"), c.get("outputs[5]"), c.get_execution_order(), c.has("z")) == ([2], None, ["a", "b"], False)
    assert c.resolve(dag.Input("zz", default=7)) == 7


def test_registry_and_steps(spark):
    with pytest.raises(KeyError, match="l2_chain"):
        registry.get("nope")
    assert {"l0_aggregator", "l1_spacy", "l1_gliner", "l2_chain", "l3_batch", "l4_reranker"} <= set(registry.list_available())
    with pytest.raises(RuntimeError):
        Factory.create_from_dict({"nodes": [{"id": "x", "processor": "l3_batch", "inputs": {}, "output": "y", "config": {"pipeline": [["bad", {}]]}}]}, spark)


def test_builder(tmp_path, spark):
    b = ConfigBuilder("n").l1.gliner(labels=["gene"]).l3().l4()
    b.l2.add("dict", priority=2).l2.add("postgres", priority=1)
    cfg = b.build()
    assert [n["id"] for n in cfg["nodes"]] == ["l1", "l2", "l3", "l4", "l0"]
    assert cfg["nodes"][-1]["inputs"]["links"]["source"] == "l4_result"
    assert cfg["nodes"][1]["config"]["layers"][0]["fuzzy"]["min_similarity"] == 0.75
    b.save(str(tmp_path / "a" / "p.yaml"))
    assert [n.id for n in Factory.create_pipeline(str(tmp_path / "a" / "p.yaml"), spark).nodes] == ["l1", "l2", "l3", "l4", "l0"]
    with pytest.raises(ValueError):
        ConfigBuilder("n").build()


def test_builder_defaults():
    b = ConfigBuilder("n").l3.configure(model="some/model")
    for kind in ("dict", "redis", "elasticsearch", "postgres"):
        b.l2.add(kind)
    x, redis, full, rel = b.l2.items
    assert (x["write"], x["ttl"], x["search_mode"], x["cache_policy"]) == (True, 0, ["exact", "fuzzy"], "always")
    assert (redis["search_mode"], redis["ttl"], redis["config"]["port"], "fuzzy" in redis) == (["exact"], 3600, 6379, False)
    assert (full["ttl"], full["cache_policy"], full["fuzzy"], full["config"]["index_name"]) == (86400, "miss", {"min_similarity": 0.3}, "entities")
    assert (rel["write"], rel["fuzzy"], rel["config"]["database"]) == (False, {"min_similarity": 0.3}, "entities_db")
    assert "embedding" not in x["field_mapping"] and b.build()["nodes"][0]["config"]["max_candidates"] == 5
    b.l2.embeddings(model_name="some/encoder")
    two = b.build()["nodes"][0]["config"]
    assert two["max_candidates"] == 10 and two["embeddings"]["model_name"] == "some/encoder" and x["field_mapping"]["embedding"] == "embedding"
    assert b.l0.values == {"min_confidence": 0.0, "include_unlinked": True, "return_all_candidates": False, "strict_matching": True, "position_tolerance": 2}
    assert b.l3.values["model_name"] == "some/model" and b.l3.values["cache_embeddings"] is False
    assert b.description == "n - auto-generated configuration" and b.build()["nodes"][1]["schema"] == {"template": "{label}: {description}"}
    assert b.l2.add("postgres", host="db", user="me").l2.items[-1]["config"] | {"password": ""} == {"host": "db", "port": 5432, "database": "entities_db", "user": "me", "password": ""}
    auto = ConfigBuilder("m").l3.configure().l2.build()["layers"]
    assert [y["fuzzy"]["min_similarity"] for y in auto] == [0.6]
    with pytest.raises(TypeError):
        b.l0.configure(no_such=1)


RECORDS = [{"entity_id": "1", "label": "Rivermouth"}, {"entity_id": "2", "label": "tidal gate", "aliases": ["sluice"]}]


def test_given_mentions_end_to_end(spark):
    ex = Factory.create_simple(spark, entities=RECORDS, external_entities=True)
    ctx = ex.execute({"texts": ["Rivermouth opened its tidal gate."], "entities": [[{"text": "Rivermouth", "start": 0, "end": 10}, {"text": "tidal gate", "start": 22, "end": 32}]]})
    assert [(r["mention_text"], r["entity_id"]) for r in ctx.get("l0_result").orderBy("mention_idx").collect()] == [("Rivermouth", "1"), ("tidal gate", "2")]
    assert ctx.get_metadata("l0_result")["stats"].first()["linked"] == 2


def test_mentions_as_texts(spark):
    ex = Factory.create_simple(spark, entities=RECORDS, external_entities=True)
    got = ex.execute({"texts": ["a", "b"], "entities": [["sluice"], [type("M", (), {"text": "Rivermouth", "start": 1, "end": 2})()]]}).get("l2_result").collect()
    assert sorted((r["text_idx"], r["entity_id"]) for r in got) == [(0, "2"), (1, "1")]


def test_models_and_encoders(spark):
    processors.MODELS["finder"] = lambda t: [(0, 6, "place", 0.9), (0, 6, "other", 0.9), (7, 9, "place", 0.2)]
    processors.ENCODERS["enc"] = lambda c: F.array(F.length(c).cast("float"))
    b = ConfigBuilder("m").set_schema_template("{label}").l1.gliner(model="finder", labels=["place"], threshold=0.5).l3.configure(model="enc", threshold=0.5, cache_embeddings=True)
    ex = Factory.create_from_dict(b.build(), spark)
    ex.load_entities(RECORDS)
    assert [(r["text"], r["label"]) for r in ex.execute({"texts": ["sluice it"]}).get("l1_result").collect()] == [("sluice", "place")]
    link = ex.processors["l3"]
    assert link.supports_precomputed_embeddings and link.chain is ex.processors["l2"].chain
    texts = spark.createDataFrame([(0, "sluice it")], "text_idx long, text string")
    mentions = spark.createDataFrame([(0, 0, "sluice", 0, 6, [1.0])], "text_idx long, mention_idx long, text string, start int, end int, vector array<float>")
    cands = ex.processors["l2"](texts=texts, mentions=mentions)
    assert [(r["text"], r["label"]) for r in link(texts=texts, candidates=cands, mentions=mentions).collect()] == [("sluice", "tidal gate")]
    assert [(r["entity_id"], r["embedding_model_id"]) for r in link.chain.all_entities().orderBy("entity_id").collect()] == [("1", None), ("2", "enc")]
    with pytest.raises(RuntimeError, match="unknown method"):
        Factory.create_from_dict({"nodes": [{"id": "x", "processor": "l2_chain", "inputs": {}, "output": "y", "config": {"pipeline": [["bad", {}]]}}]}, spark)


def test_texts_alone_end_to_end(spark):
    ctx = Factory.create_simple(spark, entities=RECORDS).execute({"texts": ["The sluice of Rivermouth.", "Nothing here."]})
    rows = ctx.get("l0_result").orderBy("text_idx", "start").collect()
    assert [(r["text_idx"], r["mention_text"], r["entity_id"], r["stage"]) for r in rows] == [(0, "sluice", "2", "l3_only"), (0, "Rivermouth", "1", "l3_only")]


def test_context_goes_where_its_frames_go(spark, tmp_path):
    c = dag.Context({})
    c.set("rows", spark.range(3), {"node": "x", "stats": spark.range(1)})
    c.set("n", [1, 2])
    c.save(str(tmp_path / "ctx"))
    got = dag.Context.load(spark, str(tmp_path / "ctx"))
    assert got.get("rows").count() == 3 and got.get("n") == [1, 2] and got.get_metadata("rows") == {"node": "x"}


def test_inputs_of_frames(spark):
    c = dag.Context({})
    rows = [(0, [("a", 1), ("b", 2)], "x"), (1, [("c", 3)], "y")]
    c.set("r", spark.createDataFrame(rows, "text_idx long, items array<struct<name:string,n:int>>, tag string"))
    got = lambda **kw: [tuple(r) for r in c.resolve(dag.Input("r", **kw)).orderBy("text_idx").collect()]
    assert got(fields="items[*].name") == [(0, ["a", "b"]), (1, ["c"])]
    assert got(fields="items[*].name", reduce="last") == [(0, "b"), (1, "c")]
    assert got(fields="tag", filter="text_idx > 0") == [(1, "y")]
    assert got(template="<{tag}>") == [(0, "<x>"), (1, "<y>")]
