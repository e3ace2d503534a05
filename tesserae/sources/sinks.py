"""Writes: append with quarantine, latest by key, insert or ignore, sealed values, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.conversation import recordable


def append_messages(messages: DataFrame, path: str, quarantine: str) -> None:
    """Recordable rows go to the log, unsafe user rows to a side table with their flags; both by day."""
    rows = recordable(messages).withColumns({"flags": T.scan_flags(F.coalesce("content", F.lit(""))), "day": F.to_date(F.timestamp_millis("ts"))})
    unsafe = (F.col("role") == "user") & (T.injection_score(F.col("flags")) >= T.SAFE_BELOW)
    rows.where(~unsafe).drop("flags").write.mode("append").partitionBy("day").parquet(path)
    rows.where(unsafe).write.mode("append").partitionBy("day").parquet(quarantine)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not there yet, each once."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest row of each key; the new one on equal versions."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__k", F.row_number().over(w)).where(F.col("__k") == 1).drop("__k", "__new")


def sealed(value: Column, key: Column, label: Column) -> Column:
    """Authenticated ciphertext (AES-GCM) of a value, bound to its label."""
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), label))


def unsealed(cipher: Column, key: Column, label: Column) -> Column:
    return F.aes_decrypt(F.unbase64(cipher), key, F.lit("GCM"), F.lit("DEFAULT"), label).cast("string")


def unsealed_or_null(cipher: Column, key: Column, label: Column) -> Column:
    """The value, or null where the key or the label is not the one it was sealed with."""
    return F.try_aes_decrypt(F.unbase64(cipher), key, F.lit("GCM"), F.lit("DEFAULT"), label).cast("string")


def append_receipts(receipts: DataFrame, path: str, most: int = 2000) -> None:
    """JSON lines, at most ``most`` a run, oldest first."""
    w = Window.partitionBy("run_id").orderBy("at", "item_id")
    receipts.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k").write.mode("append").json(path)


def snapshot(tables: dict[str, DataFrame], path: str, leave_out: tuple[str, ...] = ("vector", "embedding")) -> None:
    """All tables without their vectors."""
    for name, df in tables.items():
        df.drop(*leave_out).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
