"""Connections to outside stores. Each is tried when a plan is built, and left out of a chain when it can't be
reached; nothing is imported before it is used."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kb

LOG = logging.getLogger(__name__)


def jdbc_records(spark: SparkSession, url: str, user: str = "", password: str = "", entities: str = "entities", aliases: str = "aliases", **options: str) -> DataFrame:
    """Records of a relational store: entities with their aliases gathered in an array. Options go to both reads, those
    of a partition column among them."""
    read = lambda t: spark.read.format("jdbc").options(url=url, dbtable=t, user=user, password=password, **options).load()
    return with_aliases(read(entities), read(aliases))


def with_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """entities LEFT JOIN aliases, an empty array where there are none; a null description is ''."""
    per = aliases.groupBy("entity_id").agg(F.sort_array(F.collect_list("alias")).alias("aliases"))
    got = entities.drop("aliases").join(per, "entity_id", "left")
    return got.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).withColumn("description", F.coalesce("description", F.lit("")))


def connect(spark: SparkSession, layer) -> None:
    """Give a relational layer whose config names a `url` the records of its store, under the layer's field mapping.
    A store that can't be reached leaves its layer out of the chain."""
    c = layer.config
    if layer.kind != "postgres" or not c.get("url"):
        return
    try:
        raw = jdbc_records(spark, c["url"], c.get("user", ""), c.get("password", ""), c.get("entities", "entities"), c.get("aliases", "aliases"), **c.get("options", {}))
        layer.records = kb.map_fields(raw, layer.field_mapping, layer.kind)
        layer.available = reachable(layer)
    except Exception as e:  # drivers raise errors of their own kinds
        LOG.warning("layer %s is left out: %s", layer.name, e)
        layer.available = False


def reachable(layer) -> bool:
    """Does a layer's store answer? Its records are planned, and of an outside store one row is asked for."""
    try:
        if layer.records is None:
            return False
        return not layer.config.get("url") or layer.records.limit(1).count() >= 0
    except Exception as e:  # drivers raise errors of their own kinds
        LOG.warning("layer %s doesn't answer: %s", layer.name, e)
        return False


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as texts."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("text_idx"), F.col("value").alias("text"))


def sample_texts(texts: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """n texts in a seeded random order."""
    return texts.orderBy(F.xxhash64("text_idx", F.lit(seed)), "text_idx").limit(n)
