"""Sources: notes of a vault, attachments, events, folder sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File endings that are notes.
EXTENSIONS = ("md", "txt", "markdown")
NOTE_SCHEMA = "file string, mtime long, content string"
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event", T.StringType()), T.StructField("file", T.StringType()), T.StructField("ts", T.TimestampType()),
        T.StructField("mtime", T.LongType()), T.StructField("content", T.StringType()), T.StructField("old_file", T.StringType()),
    ]
)


def is_note(path) -> F.Column:  # noqa: ANN001
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1)).isin(*EXTENSIONS)


def relative(path, root: str) -> F.Column:  # noqa: ANN001
    """A file's path under ``root``, without scheme."""
    plain = F.regexp_replace(path, r"\A[a-z]+:/+", "/")
    return F.replace(plain, F.lit(root.split("://")[-1].rstrip("/") + "/"), F.lit(""))


def scan_vault(spark: SparkSession, root: str) -> DataFrame:
    """file, mtime (epoch ms), content of every note under ``root``; read each time.

    Files of no bytes aren't listed: an emptied note leaves the index as a deleted one does.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.filter(is_note(F.col("path"))).select(
        relative(F.col("path"), root).alias("file"), F.unix_millis("modificationTime").alias("mtime"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")
    )


def attachments(spark: SparkSession, root: str) -> DataFrame:
    """path of every other file; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.filter(~is_note(F.col("path"))).select(relative(F.col("path"), root).alias("path"), "length")


def folder_size(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def notes_of_table(docs: DataFrame, file, mtime, content) -> DataFrame:  # noqa: ANN001
    """Notes from any table that has a path, a time and a text."""
    return docs.select(file.alias("file"), mtime.cast("long").alias("mtime"), content.alias("content"))


def missing_files(source: DataFrame, target: DataFrame) -> DataFrame:
    """Files (relative, size) of ``source`` that ``target`` lacks or has in another size."""
    return source.join(target, ["relative", "size"], "left_anti")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Change events of notes, as files of JSON lines appear in ``path``: ``create``,
    ``modify``, ``delete``, and ``rename`` with the path before (``old_file``)."""
    events = spark.readStream.schema(EVENT_SCHEMA).json(path)
    return events.filter(is_note(F.col("file")) | F.coalesce(is_note(F.col("old_file")), F.lit(False)))
