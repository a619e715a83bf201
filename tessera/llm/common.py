"""What the operators share: reading tables, durable checkpoints and Arrow access to texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.folders import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1000 rows, unless the session asks for its own number: rows here are whole texts, and the default of
    10,000 would hold them several times, in the executor and in its Python workers.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, "1000")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that lost executors cost no lineage.

    The copy does not carry the plan's estimated size: estimates of joins are products, and in a loop they would grow beyond
    all bounds.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint(eager=True)
    try:
        inner = kept._jdf
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(inner.queryExecution().toRdd(), inner.schema(), False), spark)
    except AttributeError:  # not a classic session; the copy then carries the estimate
        return kept


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store; where the session can't reach the store's own methods, it stays."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except AttributeError:
        pass


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """The document id, the text with null as empty, and ``more``; any other column is left behind."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string column, and the n+1 offsets of its values in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def release() -> None:
    """Gives what a task has freed back to the system, as its Python worker lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with this C library
        pass


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into ones of at most ``most`` bytes of ``name`` each, so that work space stays bounded."""
    for batch in batches:
        if batch.num_rows:
            _, offsets = utf8(batch.column(name))
            for i, j in ranges(offsets, most):
                yield batch.slice(i, j - i)
    release()
