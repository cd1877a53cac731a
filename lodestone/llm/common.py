"""Shared helpers: tables, the shared scratch folder, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import weakref

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.shipping import ship

#: White space that ends a word: space and \\x09-\\x0D.
_SPACES = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


#: Has Spark delete a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs in one process, as in tests, a local one
    is made; on a cluster executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the
    lineage, and a lost executor costs no more than a reread. The shuffle files of the
    job go when the table is there. The table goes with :func:`discard`, or when the
    driver ends."""
    spark = df.sparkSession
    ship(spark)
    name = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    kept = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(name)
    finally:
        spark.conf.set(_CLEANUP, kept)
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    found = spark.read.schema(df.schema).parquet(name)
    _WRITTEN[found] = name
    return found


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        if df is not None and (name := _WRITTEN.pop(df, None)):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(name: str, *taken: str) -> str:
    """``name``, longer by as many underscores as keep it from being a column already.
    Spark compares names without case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def numbered(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with a number of each row, written once with the rows. A number made
    anew in every job would follow the order in which rows come, and that changes after
    shuffles, retries and with the number of executors. Numbers count up by one within
    a written file."""
    return materialize(docs.withColumn(column, F.monotonically_increasing_id()), "numbered")


def give_back() -> None:
    """Return what a worker has freed to the system: allocators keep it, and a worker that
    goes from group to group would stay as large as all its groups' shapes together."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # elsewhere than with glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix_in_place(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, over an array of uint64 that may be overwritten."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix64(x: np.ndarray) -> np.ndarray:
    return mix_in_place(x.astype(np.uint64, copy=True))


def ascii_lower(texts: pa.Array) -> pa.Array:
    """``texts`` with A-Z lower-cased, other letters as they are; null: empty.

    Works on the UTF-8 bytes: bytes below 128 are never part of another letter.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    n = len(texts)
    off = np.frombuffer(offsets, np.int64, count=n + 1, offset=8 * texts.offset)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    low = np.frombuffer(_LOWER, np.uint8)[raw]
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(off - off[0]), pa.py_buffer(low.tobytes()))


def split_runs(low: pa.Array, is_gap: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The runs of bytes of each text that ``is_gap`` (by byte) doesn't part.

    A dictionary array over all runs, each text's offset into it (one more at the
    end), and each run's first byte in the texts' data.
    """
    n = len(low)
    _, offsets, data = low.buffers()
    off = np.frombuffer(offsets, np.int64, count=n + 1)
    raw = np.frombuffer(data, np.uint8)[: off[-1]] if data is not None and off[-1] else np.zeros(0, np.uint8)
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = is_gap[raw]
    inner = ~gap[1:-1]
    begin, end = inner & gap[:-2], inner & gap[2:]
    # a text's first byte begins a run whatever stands before it
    heads = off[:-1][off[:-1] < off[1:]]
    begin[heads] = inner[heads]
    tails = heads[1:] - 1
    end[tails] = inner[tails]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    starts = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int64)
    runs = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(starts), pa.py_buffer(raw[inner].tobytes()))
    return runs.dictionary_encode(), np.searchsorted(s, off), s


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of A-Z-lowered texts, and each text's offset."""
    return split_runs(ascii_lower(texts), _IS_SPACE)[:2]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACES)] = True


def hash_words(words: pa.DictionaryArray) -> np.ndarray:
    """64-bit keyed hash of each word, computed once per distinct word."""
    distinct = words.dictionary.to_numpy(zero_copy_only=False).astype(object)
    if not len(distinct):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(distinct, categorize=False)[words.indices.to_numpy(zero_copy_only=False)]


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width``-word shingles that begin at each position but the
    last ``width - 1``."""
    n = len(word_hashes) - width + 1
    h = np.full(max(n, 0), width, np.uint64)
    for i in range(width):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : i + n]) if n > 0 else h
    return h


def text_slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> list[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``most`` bytes of text: bounds a worker's memory."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
