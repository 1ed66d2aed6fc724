"""Sessions whose Python workers can import this package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a worker reads at once, and rows that it is sent and sends at once.
TEXT_BYTES, BATCH_ROWS = 1 << 18, 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Let workers import the package from the driver's folder where they can reach it; where they can't, it is
    installed there. Arrow batches have at most BATCH_ROWS rows, since a row may be a long text."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    return spark


def pieces(batches, column: int = 1, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut between rows so that each has at most so many bytes of text in a column, or one row: what a
    worker makes of its texts is held for one piece, however many rows a task or a batch has."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i, done = 0, 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(upto, done + most, "right")))
            yield b.slice(i, j - i)
            i, done = j, upto[j - 1]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: `spark.checkpoint.dir`. Where that is unset a local session gets a temporary
    one, made once; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("linkloom.shared.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("linkloom.shared.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut a long lineage: `df` written as Parquet in the folder that all machines share and read again. Plans that
    several later steps share stay small."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/linkloom/plan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
