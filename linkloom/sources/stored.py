"""A stored index of names: the keys of records as bucketed files with versions, so that a search plans no rebuild.

Each write is a version: a base, or a delta whose records take the place of earlier ones of their ids. A version counts
once its row is in the manifest, which is written last, so a write that was cut short is as if it had not been. A
lookup reads the buckets its queries fall into, of the versions since the last base; compaction writes a new base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kb

FORMS = "key string, entity_id string, kind string, load_ord long"


class KeyStore:
    """Keys under a folder that all machines share. One writer at a time; readers see whole versions."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        """A part of the store, if anything was written to it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(schema).parquet(str(path))

    def versions(self) -> list[tuple[int, bool]]:
        """(version, is it a base) of those in force: from the last base on. One row a write is in the manifest."""
        rows = self._read("manifest", "version int, base boolean")
        got = sorted((r["version"], r["base"]) for r in rows.collect()) if rows is not None else []
        last = max((v for v, base in got if base), default=0)
        return [x for x in got if x[0] >= last]

    def _write(self, forms: DataFrame, ids: DataFrame, base: bool) -> int:
        written = self._read("manifest", "version int, base boolean")
        version = 1 + (written.agg(F.max("version")).first()[0] if written is not None else 0)
        forms.withColumn("bucket", self._bucket("key")).repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/forms/version={version}")
        ids.select("entity_id").distinct().write.mode("overwrite").parquet(f"{self.folder}/ids/version={version}")
        self.spark.createDataFrame([(version, base)], "version int, base boolean").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return version

    def write(self, records: DataFrame) -> int:
        """Store records' names: as a base if there is none, else as a delta. The version."""
        forms = kb.surface_forms(records).select("key", "entity_id", "kind", "load_ord")
        return self._write(forms, records, not self.versions())

    def forms(self, buckets: list[int] | None = None) -> DataFrame:
        """The keys in force (of some buckets): those of no record that a later version has."""
        live = [v for v, _ in self.versions()]
        rows = self._read("forms", FORMS + ", version int, bucket int")
        if rows is None or not live:
            return self.spark.createDataFrame([], FORMS + ", bucket int")
        rows = rows.filter(F.col("version").isin(live))
        rows = rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))
        if len(live) > 1:
            ids = self._read("ids", "entity_id string, version int").filter(F.col("version").isin(live[1:]))
            last = ids.groupBy("entity_id").agg(F.max("version").alias("last"))
            rows = rows.join(last, "entity_id", "left").filter(F.col("last").isNull() | (F.col("version") >= F.col("last")))
        return rows.select("key", "entity_id", "kind", "load_ord", "bucket")

    def compact(self) -> int:
        """A new base of the keys in force; older versions are no longer read."""
        forms = self.forms().drop("bucket")
        return self._write(forms, forms, True)

    def lookup(self, queries: DataFrame) -> DataFrame:
        """Keys that equal a query (q): (q, entity_id, kind, load_ord). Of the buckets, `buckets` at most, only those
        of the queries are read."""
        asked = queries.select("q", self._bucket("q").alias("bucket"))
        own = sorted(r["bucket"] for r in asked.filter("q is not null").select("bucket").distinct().collect())
        return asked.withColumnRenamed("q", "key").join(self.forms(own), ["bucket", "key"]).select(F.col("key").alias("q"), "entity_id", "kind", "load_ord")
