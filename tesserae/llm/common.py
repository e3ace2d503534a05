"""What the training-data operators share: scans, Arrow batches, shared tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..ship import shipped

#: Text bytes handled at once inside a Python worker; bounds its memory.
BLOCK_BYTES = 4 << 20


#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; from here on the session's Arrow batches have at most BATCH_ROWS rows."""
    shipped(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only where unset, as in tests."""
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back. Survives lost executors.

    ``batch_rows`` bounds the rows of an Arrow batch while this table is made, for wide rows.
    """
    shipped(df.sparkSession)
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    try:
        if batch_rows:
            conf.set(key, batch_rows)
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of finished jobs now: it does so when their objects are collected."""
    gc.collect()
    spark._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Remove the files behind a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(_lengths(batch.column(batch.schema.get_field_index(column))), dtype=np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def _lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)


def utf8(col: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]
