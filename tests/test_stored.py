"""The stored index of names: the same answers as records give, without building it again."""

import random

from linkloom.operators import candidates as C
from linkloom.sources import kb, stored
from pyspark.sql import functions as F


def rows_of(n, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice("ab") + str(rng.randrange(9))
    return [dict(entity_id=str(rng.randrange(40)), label=name(), aliases=[name() for _ in range(rng.randrange(3))]) for _ in range(n)]


def test_base_deltas_and_compaction(spark, tmp_path):
    layer = kb.Layer("a", keys=stored.KeyStore(spark, f"file://{tmp_path}/keys", 8))
    qs = spark.createDataFrame([(a + str(i),) for a in "abc" for i in range(9)] + [(None,)], "q string")
    answers = lambda keys: sorted(map(tuple, C.exact(qs, layer.records, keys).collect()))
    assert layer.keys.lookup(qs).count() == 0 and layer.keys.versions() == []
    for step, over in enumerate((False, False, True, True)):
        layer.load(kb.read_records(spark, rows_of(25, step)).withColumn("load_ord", F.col("load_ord") + 100 * step).persist(), over)
        assert answers(layer.keys) == answers(None) and len(answers(None)) > 10
    assert layer.keys.versions() == [(1, True), (2, False), (3, False), (4, False)]
    before = answers(None)
    layer.keys.compact()
    assert layer.keys.versions() == [(5, True)] and answers(layer.keys) == before
    # A version without its row in the manifest is not there.
    kb.surface_forms(layer.records).limit(5).select("key", "entity_id", "kind", "load_ord").write.parquet(f"file://{tmp_path}/keys/forms/version=6/bucket=0")
    assert answers(layer.keys) == before


def test_a_search_reads_its_buckets_and_builds_nothing(spark, tmp_path):
    keys = stored.KeyStore(spark, f"file://{tmp_path}/keys", 16)
    keys.write(kb.read_records(spark, rows_of(60, 9)))
    plan = C.exact(spark.createDataFrame([("a1",)], "q string"), None, keys)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


