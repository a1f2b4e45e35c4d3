"""Readers of the raw formats, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMENT_SCHEMA = ", ".join(
    f"{c} string" for c in "postId commentId userId username commentText created location description verified private avatarUrl parentCommentId".split()
)
_BUILT_IN = ("utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32")
ENCODINGS = ("utf-8", "gbk", "cp1252", "iso-8859-1")


def probe_encoding(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS, sample_bytes: int = 1 << 20) -> str:
    """The first encoding that decodes the head of the first file (a bounded sample)."""
    # a binaryFile row holds a whole file, so only the first file is opened, through Hadoop, and only its head
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    statuses = [s for s in (fs.globStatus(target) or []) if s.isFile()] or [s for s in fs.listStatus(target) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    first = min(statuses, key=lambda s: s.getPath().toString())
    stream = fs.open(first.getPath())
    try:
        head = bytes(b & 0xFF for b in stream.readNBytes(min(sample_bytes, first.getLen())))
    finally:
        stream.close()
    for encoding in encodings:
        try:
            head.decode(encoding)
        except UnicodeDecodeError as bad:
            if bad.start < len(head) - 4 or len(head) < sample_bytes:
                continue
        return encoding
    return "iso-8859-1"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, limit: int | None = None, encoding: str | None = None) -> DataFrame:
    """CSV with a header.  Without a schema all columns are strings: no pass over the data to infer one.

    Encodings beyond Spark's short list need its setting for all Java character sets, which is turned on
    for the session when one is met.
    """
    encoding = encoding or probe_encoding(spark, path)
    if encoding.lower() not in _BUILT_IN:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.limit(limit) if limit is not None else df


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; unreadable lines and rows without ``postId`` are dropped."""
    df = spark.read.schema(COMMENT_SCHEMA + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return df.where("_corrupt_record IS NULL AND postId IS NOT NULL AND postId <> ''").drop("_corrupt_record")


def read_url_map(spark: SparkSession, path: str) -> DataFrame:
    """``post_id, url`` from lines split at the first comma; of a repeated post the last line counts."""
    parts = F.split(F.col("value"), ",", 2)
    rows = spark.read.text(path).where(F.size(parts) == 2).select(F.trim(parts[0]).alias("post_id"), F.trim(parts[1]).alias("url"), F.monotonically_increasing_id().alias("line"))
    return rows.groupBy("post_id").agg(F.max_by("url", "line").alias("url"))


def read_json(spark: SparkSession, path: str, limit: int | None = None, schema: str | None = None, lines: bool = False) -> DataFrame:
    """A whole JSON document a file, or JSON lines."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.json(path, multiLine=not lines)
    return df.limit(limit) if limit is not None else df


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word list, one entry a line: lower case, trimmed, distinct, without empty lines."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, is_bullying`` from a JSON object of session -> 0/1 or a list of records."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,int>")).alias("session_id", "is_bullying"))
    records = text.select(F.explode(F.from_json("value", "array<struct<post_id:string,is_bullying:int>>")).alias("r")).select(F.col("r.post_id").alias("session_id"), "r.is_bullying")
    return pairs.unionByName(records).where("session_id IS NOT NULL")


def load(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    if format not in ("parquet", "json", "csv", "orc"):
        raise ValueError(f"unknown format: {format}")
    return spark.read.option("header", True).format(format).load(path)


def read_session(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """One session of a table partitioned by session; only its folder is read."""
    return spark.read.parquet(path).where(F.col("session_id") == session_id)
