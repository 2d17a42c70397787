"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import ensure_checkpoint_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder (never machine-local on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet into the shared folder and read it back.

    Cuts the lineage, survives lost executors, and lets later steps read only
    the columns they use.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete the folder of a ``stored`` table that no later step reads, so that disk holds what is in use only."""
    spark = table.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_memory() -> None:
    """Give back to the system what earlier tasks of this Python worker have freed. Workers outlive their
    stage, and the allocator keeps the pages of large numpy arrays otherwise."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):      # not glibc: nothing to do
        ctypes.CDLL("libc.so.6").malloc_trim(0)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
DOCUMENT_BATCH = "4m"


def document_batches(spark: SparkSession) -> None:
    """Texts go to Python in Arrow batches of few MB, unless the session has its own bound.

    A task holds a batch several times outside the heap (column buffers, the bytes on their way, the
    worker's copy), each grown by doubling; Spark's own bound is 64 MB, more than many tasks' whole input.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, DOCUMENT_BATCH)


BROADCAST_ROWS = 1_000_000      # tables of ids (8 bytes each) are broadcast up to here


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its row count is within the bound; otherwise joined by shuffle."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def offsets_before(counts: DataFrame, order: str, value: str, out: str,
                   keys: Sequence[str] = ()) -> DataFrame:
    """``out`` = sum of ``value`` over the rows of the same keys with a smaller ``order``.

    ``counts`` holds one row per (keys, shard), so the window is bounded by the shard count.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))
