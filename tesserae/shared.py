"""The folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid


def shared_dir(spark) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and the master is local, as in tests."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tesserae-shared-")


def new_folder(spark, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def written(df, kind: str = "tables", batch_rows: int | None = None):
    """The rows as a table in the shared folder: the lineage ends here. ``batch_rows`` bounds the rows of its Arrow batches, for wide rows."""
    path, conf, key = new_folder(df.sparkSession, kind), df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    try:
        if batch_rows:
            conf.set(key, batch_rows)
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark) -> None:
    """Let Spark remove the shuffle files of finished jobs now: it does so when their objects are collected."""
    gc.collect()
    spark._jvm.System.gc()


def exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
