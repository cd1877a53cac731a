"""Import of an index in four files: passages as one JSON array, vectors and phrase
vectors as packed binary, and a state record. Rows and vectors belong together by
position, so lengths are checked before anything is read as an index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources import index_store
from lodestone.sources.index_store import CANDIDATE, DamagedIndex

OTHER_FILES = ("index.state.json",)
FILES = ("index.meta.json", "index.vectors.bin", "index.highlights.bin")
_META = (
    "file string, heading string, text string, lineStart int, lineEnd int, mtime long, contentHash string, highlightVersion int, "
    "highlightCandidates array<struct<phrase: string, field: string, sentenceId: int, start: int, `end`: int, words: int, hasNoun: boolean, "
    "hasVerb: boolean, hasExpression: boolean, adjectiveOnly: boolean, quality: double>>"
)


def _vectors(spark: SparkSession, path: str, dimension: int, kind: str) -> DataFrame:
    """place, vector of each row of a packed file (one file is one record)."""
    code, arrow = {"float": ("<f4", pa.float32()), "smallint": ("<i2", pa.int16())}[kind]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                flat = np.frombuffer(content.as_py(), code)
                for at in range(0, len(flat) // dimension, 4096):
                    part = flat[at * dimension : (at + 4096) * dimension]
                    offsets = pa.array(np.arange(0, len(part) + 1, dimension), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part) // dimension)), pa.ListArray.from_arrays(offsets, pa.array(part, arrow))], ["place", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, f"place long, vector array<{kind}>")


def read_packed_index(spark: SparkSession, root: str, dimension: int) -> DataFrame:
    """An index in the store's schema."""
    meta = spark.read.schema(_META).option("multiLine", True).json(f"{root}/{FILES[0]}")
    rows = meta.withColumn("place", F.monotonically_increasing_id())  # one file, one partition
    phrases = F.coalesce("highlightCandidates", F.array().cast(meta.schema["highlightCandidates"].dataType))
    rows = rows.withColumn("_c", phrases)
    sizes = {r.path.rsplit("/", 1)[-1]: r.length for r in spark.read.format("binaryFile").load([f"{root}/{f}" for f in FILES[1:]]).select("path", "length").collect()}
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("_c")), F.lit(0)).alias("c")).first()
    if sizes[FILES[1]] != counts.n * dimension * 4 or sizes[FILES[2]] != counts.c * dimension * 2:
        raise DamagedIndex(f"vectors in {root} don't match {counts.n} passages and {counts.c} phrases")
    spread = rows.select("place", F.posexplode("_c").alias("pos", "c"))
    # a phrase's place in the packed file: all phrases before it, in order of passages;
    # summed within each partition of the scan, and over the partitions
    rows = rows.withColumn("_p", F.shiftright("place", 33))
    within = Window.partitionBy("_p").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of one file
    sums = rows.groupBy("_p").agg(F.sum(F.size("_c").cast("long")).alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(across), F.lit(0)))
    starts = rows.select("_p", "place", F.coalesce(F.sum(F.size("_c").cast("long")).over(within), F.lit(0)).alias("_own")).join(sums.select("_p", "_before"), "_p")
    spread = spread.join(starts.select("place", (F.col("_own") + F.col("_before")).alias("start")), "place").withColumn("at", F.col("start") + F.col("pos"))
    with_vector = spread.join(_vectors(spark, f"{root}/{FILES[2]}", dimension, "smallint").withColumnRenamed("place", "at"), "at")
    lists = with_vector.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("pos", "c", "vector"))).alias("l"))
    candidates = F.transform("l", lambda x: x["c"].withField("vector", x["vector"]))
    joined = rows.join(_vectors(spark, f"{root}/{FILES[1]}", dimension, "float"), "place").join(lists, "place", "left")
    number = F.row_number().over(Window.partitionBy("file").orderBy("place")) - 1
    return joined.select(
        "file", number.alias("chunk_no"), "heading", "text", F.col("lineStart").alias("line_start"), F.col("lineEnd").alias("line_end"), "mtime", F.col("contentHash").alias("content_hash"),
        F.col("highlightVersion").alias("highlight_version"), F.col("vector").alias("embedding"), F.coalesce(candidates.cast(f"array<{CANDIDATE}>"), F.array().cast(f"array<{CANDIDATE}>")).alias("candidates"),
    )


def migrate(spark: SparkSession, source: str, root: str, dimension: int) -> int:
    """Import the packed files in ``source`` as the index in ``root``, then delete them.
    They stay if anything goes wrong before the new index can be read back."""
    rows = read_packed_index(spark, source, dimension)
    number = index_store.save(rows, root)
    index_store.require_valid(index_store.load(spark, root), dimension)
    folder = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in (*FILES, *OTHER_FILES):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{source}/{name}"), False)
    return number
