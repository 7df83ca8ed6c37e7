"""What the operators of this subpackage share: shared storage and Arrow plumbing.

Rules that hold for every operator here:

* ``doc_id`` may be null in a map-only operator (the row is answered like any other); an operator
  that relates documents to each other says in its own docstring what a null id means.
* A null text counts as the empty text unless the operator says otherwise.
* Columns other than the named ones are ignored, so they may clash with output names.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of documents that pass between the JVM and a Python worker at once: with whole texts, Spark's 10,000 are tens of MB on both sides.
BATCH_ROWS = "1000"


def small_arrow_batches(docs: DataFrame) -> DataFrame:
    """docs; the session's Arrow batches are made smaller, unless its owner has set them."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, BATCH_ROWS)
    return docs


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named further columns, nothing else."""
    doc_id = F.col("doc_id") if docs.schema["doc_id"].dataType.typeName() == "long" else F.col("doc_id").cast("long").alias("doc_id")
    return small_arrow_batches(docs).select(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where it is unset and everything runs in one process (tests) a local one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends here, and a lost executor loses nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes stashed tables of which everything that was made of them has been stashed itself."""
    for t in tables:
        if path := getattr(t, "_stashed_at", None):
            drop_path(t.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stashed inside are deleted at the end. A result made of them has to be written before; ``keep`` excepts it."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            drop_path(spark, path)


def keep(table: DataFrame) -> DataFrame:
    """The same table, which is its owner's from now on."""
    _written.remove(table._stashed_at)
    return table


_holder: list = []


def hold(name: str, clear) -> None:
    """Says that a worker now keeps the cache ``name``; the cache of another operator that ran in this worker before is cleared."""
    if _holder and _holder[0] != name:
        _holder[1]()
        give_back()
    _holder[:] = [name, clear]


def give_back() -> None:
    """Returns freed memory to the system: a worker is kept for later tasks of other operators, beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def flat_bytes(column: pa.Array) -> tuple[memoryview, list[int]]:
    """UTF-8 bytes of a string column without a copy, and each row's start in them (one more at the end). Nulls: empty."""
    big = column.cast(pa.large_string()).cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    import numpy as np

    offsets = np.frombuffer(big.buffers()[1], dtype=np.int64)[big.offset : big.offset + len(big) + 1] if len(big) else np.zeros(1, np.int64)
    data = big.buffers()[2]
    return (memoryview(data) if data is not None else memoryview(b"")), offsets


def small_batches(batch: pa.RecordBatch, text: str, most: int = 4 << 20):
    """Slices of a batch with at most about ``most`` bytes of text each, one row at least: memory stays bounded."""
    import numpy as np

    _, offsets = flat_bytes(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end
