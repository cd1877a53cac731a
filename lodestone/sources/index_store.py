"""The index as snapshots in a folder, in buckets of files.

A snapshot is a manifest: how many buckets there are, and for each the version that
wrote it last. An update writes only the buckets that it changes, then a manifest that
points at these and at the old ones otherwise. Readers take the last manifest; it is
renamed into place when all else is there, so old passages stay readable until then.

There are as many buckets as keep each at about ``BUCKET_ROWS`` passages. An index that
has outgrown its buckets four times is dealt anew when it is next written whole.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the version of the candidates' rules; older passages are made anew.
HIGHLIGHT_VERSION = 1
#: Passages in a part of an index that is rewritten on its own (about 100 MB).
BUCKET_ROWS = 50_000
#: Passages that a note is taken to have, before it is cut.
NOTE_PASSAGES = 4
CANDIDATE = (
    "struct<phrase: string, field: string, sentence_id: int, start: int, `end`: int, words: int, has_noun: boolean, has_verb: boolean, "
    "has_expression: boolean, adjective_only: boolean, quality: double, vector: array<smallint>>"
)
SCHEMA = (
    "file string, chunk_no int, heading string, text string, line_start int, line_end int, mtime long, content_hash string, "
    f"highlight_version int, embedding array<float>, candidates array<{CANDIDATE}>"
)


class DamagedIndex(Exception):
    """An index folder that holds no complete or no consistent snapshot."""


class _Folder:
    """A folder of any store that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.jvm = spark._jvm
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def names(self, *parts: str) -> list[str] | None:
        path = self.path(*parts)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else None

    def read(self, *parts: str) -> str:
        with_lines = self.spark.read.text(str(self.path(*parts)), wholetext=True)
        return with_lines.first().value

    def write(self, content: str, *parts: str) -> None:
        """Written under another name, then renamed."""
        draft = self.path(*parts[:-1], f".{parts[-1]}.draft")
        out = self.fs.create(draft, True)
        out.write(bytearray(content.encode()))
        out.close()
        self.fs.rename(draft, self.path(*parts))


def bucket_of(file: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(buckets)).cast("int")


class Manifest(NamedTuple):
    number: int
    #: How many buckets there are.
    buckets: int
    #: The version that wrote each bucket that has rows.
    versions: dict[int, int]


def manifest(spark: SparkSession, root: str) -> Manifest | None:
    """The last snapshot; None if there never was an index."""
    folder = _Folder(spark, root)
    names = folder.names()
    if names is None:
        return None
    numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))
    if not numbers:
        raise DamagedIndex(f"{root} holds no complete snapshot")
    found = json.loads(folder.read(f"manifest-{numbers[-1]:09d}.json"))
    return Manifest(numbers[-1], found["buckets"], {int(b): v for b, v in found["versions"].items()})


def buckets_of(spark: SparkSession, root: str, files: DataFrame) -> list[int] | None:
    """The buckets that hold ``files`` (file); None, for all, if there is no index yet."""
    found = manifest(spark, root)
    if not found:
        return None
    return sorted(r[0] for r in files.select(bucket_of(F.col("file"), found.buckets)).distinct().collect())  # at most all buckets


def load(spark: SparkSession, root: str, buckets: list[int] | None = None) -> DataFrame:
    """The last snapshot, or some buckets of it; no rows if there never was an index."""
    found = manifest(spark, root)
    wanted = {b: v for b, v in (found.versions if found else {}).items() if buckets is None or b in buckets}
    if not wanted:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*[f"{root}/v{v:09d}/bucket={b}" for b, v in sorted(wanted.items())])


def prepare(spark: SparkSession, root: str, notes: DataFrame) -> int:
    """The number of buckets; where there is no index, an empty one for ``notes`` is made."""
    if found := (manifest(spark, root) if _Folder(spark, root).names() else None):
        return found.buckets
    folder = _Folder(spark, root)
    buckets = max(1, -(-notes.count() * NOTE_PASSAGES // BUCKET_ROWS))
    folder.fs.mkdirs(folder.path())
    folder.write(json.dumps({"buckets": buckets, "versions": {}}), f"manifest-{1:09d}.json")
    return buckets


def save(index: DataFrame, root: str, buckets: list[int] | None = None) -> int:
    """Write a new snapshot: all of it, or ``buckets`` with the others as they were.
    ``index`` then holds the rows of these buckets alone. Returns the snapshot's number."""
    spark = index.sparkSession
    folder = _Folder(spark, root)
    before = manifest(spark, root) if folder.names() else None
    number = before.number + 1 if before else 1
    count = before.buckets if before else 0
    columns = [f.name for f in spark.createDataFrame([], SCHEMA).schema]
    rows = index.select(*columns)
    if buckets is None:  # counted and written of one computation
        rows = rows.persist(StorageLevel.DISK_ONLY)
        needed = max(1, -(-rows.count() // BUCKET_ROWS))
        count = needed if not count or needed > 4 * count else count
    placed = rows.withColumn("bucket", bucket_of(F.col("file"), count))
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/v{number:09d}")
    if buckets is None:
        rows.unpersist()
    fresh = {int(n.split("=")[1]): number for n in folder.names(f"v{number:09d}") or [] if n.startswith("bucket=")}
    kept = {b: v for b, v in before.versions.items() if b not in buckets} if before and buckets is not None else {}
    folder.write(json.dumps({"buckets": count, "versions": kept | fresh}), f"manifest-{number:09d}.json")
    return number


def validate(index: DataFrame, dimension: int) -> DataFrame:
    """One row: passages, and how many have a vector, or a candidate's vector, of
    another length. Both must be 0."""
    bad = F.exists(F.coalesce("candidates", F.array().cast(f"array<{CANDIDATE}>")), lambda c: F.coalesce(F.size(c["vector"]), F.lit(-1)) != dimension)
    return index.agg(
        F.count(F.lit(1)).alias("passages"),
        F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != dimension).alias("bad_vectors"),
        F.count_if(bad).alias("bad_candidates"),
    )


def require_valid(index: DataFrame, dimension: int) -> DataFrame:
    found = validate(index, dimension).first()
    if found.bad_vectors or found.bad_candidates:
        raise DamagedIndex(f"{found.bad_vectors} passages and {found.bad_candidates} with candidates have vectors that aren't of length {dimension}")
    return index
