"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts may be long, so a batch is kept small.
BATCH_ROWS = 256
#: Rows that may be broadcast: a side of this many ids or short terms stays below some 20 MB.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; Spark reads it, so the folder may be in any store."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hand Python few rows at a time: a bound on a worker's memory when texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the context has, or else that of spark.checkpoint.dir; one of our own only where neither is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir", "/tmp/checkpoints"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    checkpoint_folder(df.sparkSession)
    give_back()
    return df.checkpoint()


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have, whatever the case of its names."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name in taken:
        name = f"_{name}"
    return name


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows of fold 2 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """False for a null id: it has no fold."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def pieces(items: Iterable, size: int) -> Iterator[list]:
    batch: list = []
    for item in items:
        batch.append(item)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def cut_to_table(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet in the checkpoint folder, and read again."""
    path = f"{checkpoint_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}/{name}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def give_back() -> None:
    """At the end of a task, and in the driver at each cut: what Python has freed goes back to the system, as workers and the driver live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        return
