"""Typed views of the base tables, and readers of the file formats the engine takes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import shipped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a message log: id, user_id, session_id, role, content, ts (milliseconds)."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 1000 + turn AS id",
        "concat('u', conv_id % 7) AS user_id",
        "concat('s', conv_id) AS session_id",
        "role",
        "text AS content",
        "conv_id * 600000 + turn * 90000 AS ts",
    )


#: The same view for SQL engines that read the base tables.
MESSAGES_SQL = "SELECT conv_id * 1000 + turn AS id, 'u' || (conv_id % 7) AS user_id, 's' || conv_id AS session_id, role, text AS content, conv_id * 600000 + turn * 90000 AS ts FROM conversations"


def transcripts(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON-lines transcripts: user and assistant rows with content. Strict reading fails on a malformed line, else it is skipped."""
    schema = "role string, content string, timestamp long, session_id string"
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return rows.where(F.col("role").isin("user", "assistant") & (F.length(F.trim("content")) > 0))


def within_budget(rows: DataFrame, max_chars: int, by: list[str], order: list[Column], text: str = "content") -> DataFrame:
    """The first rows of each group whose texts fit a budget of characters together."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__used", F.sum(F.length(text)).over(w)).where(F.col("__used") <= max_chars).drop("__used")


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """Receipts of a run, one JSON object a line; lines of another shape are skipped."""
    return spark.read.schema("run_id string, item_id string, disposition string, at long").option("mode", "DROPMALFORMED").json(path)


def garbage_marks(df: DataFrame, column: str = "value") -> DataFrame:
    """(id, at) of a JSON object id -> time; what does not parse is no mark."""
    marks = F.from_json(column, "map<string,bigint>")
    return df.select(F.explode(marks).alias("id", "at")).where("at IS NOT NULL")


def summaries(spark: SparkSession, path: str, max_bytes: int = 65536) -> DataFrame:
    """Markdown summaries: path, owner, period start and end from the header, body; only the first bytes of a file are parsed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    text = F.decode(F.substring("content", 1, max_bytes), "UTF-8")
    head = lambda key: F.regexp_extract(text, rf"(?m)^{key}:\s*(.+?)\s*$", 1)
    return files.select("path", head("owner").alias("owner"), F.to_date(F.nullif(head("period_start"), F.lit(""))).alias("period_start"), F.to_date(F.nullif(head("period_end"), F.lit(""))).alias("period_end"), F.regexp_replace(text, r"(?s)^---.*?---\s*", "").alias("body"), "length")


def bullets(df: DataFrame, header: str, column: str = "text") -> DataFrame:
    """Bullets under a header of a Markdown text, in order: every line knows the last header above it."""
    line = F.posexplode(F.split(column, "\n")).alias("pos", "line")
    rows = df.select(F.monotonically_increasing_id().alias("doc"), column).select("doc", line)
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    under = F.last(F.regexp_extract("line", r"^#+\s+(.*?)\s*$", 1).alias("h"), ignorenulls=True)
    heads = rows.withColumn("h", F.when(F.col("line").rlike(r"^#+\s"), F.regexp_extract("line", r"^#+\s+(.*?)\s*$", 1)))
    del under
    return heads.withColumn("section", F.last("h", ignorenulls=True).over(w)).where((F.col("section") == header) & F.col("line").rlike(r"^\s*[-*]\s+")).select("doc", "pos", F.regexp_replace("line", r"^\s*[-*]\s+", "").alias("bullet"))


def disk_usage(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and files by directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "length")
    return files.groupBy("dir").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
