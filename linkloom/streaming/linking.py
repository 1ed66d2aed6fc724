"""Linking over streams: texts arrive, the knowledge base stands. Every batch goes through the same lazy steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def link_stream(texts: DataFrame, link: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run `link` on each micro-batch of the streaming texts (text_idx, text) and hand the result to `sink` with
    the batch's number, by which an idempotent sink knows a repeated batch."""
    return texts.writeStream.foreachBatch(lambda df, n: sink(link(df), n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def exact_stream(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """Exact lookup as a stream-static join: streaming mentions (with a column q) against the label index."""
    return mentions.join(index.withColumnRenamed("key", "q"), "q", "left")
