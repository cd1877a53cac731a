"""Sharding by histogram sort, under the law of equal bytes.

Rows are ordered by a long key; rows with the same key by a number that is written
with them once. Splitters that cut this order into shards of equal bytes are found by
counting: every round, each partition of the narrow key columns counts the exact
bytes and rows below a set of candidate boundaries, the counts are summed, and
the boundaries are refined until each is within the tolerance of its target or
can't be moved by one row without missing it by more. The driver holds a fixed number
of probes for each of the shards' boundaries, whatever the table's size. Then the rows
move once.

A shard has several parts of about ``part_bytes``, so that no task gets more than
a part, however large a shard is: its rows are dealt to them by hash, and each part is
sorted, so a shard is as many sorted runs as it has parts. Parts are the exchange's
partitions, by number. A row's slot in its shard is its part's offset, from a count of
the rows of each part, and the place in the part.

Cases: a null text has size 8; null keys come first; equal keys, repeated rows
and large groups of equal texts are cut anywhere, as the law of equal bytes asks; the
row's number breaks ties; a table without rows gives none; further columns are kept; a
column of the input that is called size, shard or slot is replaced, all others keep
their values, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import fresh_name, materialize, table

_LOW = -(1 << 63)
_PROBES = 8
#: Up to so many parts' offsets (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_PARTS = 1_000_000


def _join(k: int, m: int) -> int:
    return ((k - _LOW) << 64) | m


def _parts_of(x: int) -> tuple[int, int]:
    return (x >> 64) + _LOW, x & ((1 << 63) - 1) if not (x >> 63) & 1 else (1 << 63) - 1


def _below(k: np.ndarray, m: np.ndarray, probes: list[tuple[int, int]]) -> np.ndarray:
    """How many of the rows (sorted by k, then m) are below each probe."""
    pk = np.array([p[0] for p in probes], np.int64)
    lo, hi = np.searchsorted(k, pk, "left"), np.searchsorted(k, pk, "right")
    return np.array([a if a == b else a + np.searchsorted(m[a:b], p[1], "left") for a, b, p in zip(lo, hi, probes, strict=True)], np.int64)


def _count_below(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int]]:
    pairs = [_parts_of(p) for p in probes]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(pairs)), np.int64)
        for b in batches:
            k, m, size = (b.column(i).to_numpy() for i in range(3))
            order = np.lexsort((m, k))
            at = _below(k[order], m[order], pairs)
            total += [np.concatenate([[0], np.cumsum(size[order])])[at], at]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pairs)), pa.int32()), pa.array(total[0]), pa.array(total[1])], ["i", "bytes", "rows"])

    got = keys.mapInArrow(count, "i int, bytes long, rows long").groupBy("i").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r")).collect()
    return {probes[x.i]: (x.b, x.r) for x in got}


def find_splitters(keys: DataFrame, parts: int, tolerance: float) -> tuple[list[tuple[int, int]], list[int], int]:
    """Boundaries between ``parts`` parts of equal bytes; the rows below each.

    ``keys`` has k, m and size. Between rounds the driver holds a fixed number of
    probes for each boundary, never rows.
    """
    top = keys.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    if not top.rows:
        return [], [], 0
    total = int(top.bytes)
    goal = [total * j // parts for j in range(1, parts)]
    slack = tolerance * total / parts
    known = {_join(top.lo, 0): (0, 0), _join(top.hi + 1, 0) if top.hi < (1 << 63) - 1 else (1 << 128) - 1: (total, top.rows)}
    ends = sorted(known)
    bracket = [(ends[0], ends[1])] * len(goal)
    done: dict[int, int] = {}
    while len(done) < len(goal):
        probes: set[int] = set()
        for j in range(len(goal)):
            if j not in done:
                lo, hi = bracket[j]
                probes |= {lo + (hi - lo) * i // (_PROBES + 1) for i in range(1, _PROBES + 1)} - {lo, hi}
                if (hi >> 64) - (lo >> 64) > 1:  # whole keys first: they are all that most tables need
                    probes |= {((lo + (hi - lo) * i // (_PROBES + 1)) >> 64) + 1 << 64 for i in range(1, _PROBES + 1)} - {lo, hi}
        probes -= known.keys()
        if probes:
            known |= _count_below(keys, sorted(probes))
        ranked = sorted(known)
        sums = np.array([known[p][0] for p in ranked], np.int64)
        for j, g in enumerate(goal):
            if j in done:
                continue
            at = int(np.searchsorted(sums, g, "right"))
            lo, hi = ranked[max(at - 1, 0)], ranked[min(at, len(ranked) - 1)]
            best = min((lo, hi), key=lambda p: abs(known[p][0] - g))
            one_row = known[hi][1] - known[lo][1] <= 1
            if abs(known[best][0] - g) <= slack or one_row or hi - lo <= 1:
                done[j] = best
            bracket[j] = (lo, hi)
    cut = sorted(done.values())
    return [_parts_of(p) for p in cut], [known[p][1] for p in cut], top.rows


def _shard_of(k: str, m: str, cuts: list[tuple[int, int]]) -> Column:
    """How many boundaries are at or below a row."""
    at_or_above = [((F.col(k) > ck) | ((F.col(k) == ck) & (F.col(m) >= cm))).cast("int") for ck, cm in cuts]
    return reduce(lambda a, b: a + b, at_or_above, F.lit(0))


def histogram_sort(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, part_bytes: int = 32 << 20, tolerance: float = 0.002) -> DataFrame:
    """The rows of ``df`` with size, shard and slot, moved to their shards' parts."""
    k, m, part, before = (fresh_name(n, *df.columns) for n in ("_k", "_m", "_part", "_before"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    sized = df.withColumns({k: F.coalesce(F.col(key).cast("long"), F.lit(_LOW)), m: F.monotonically_increasing_id()}).withColumn(part, size)
    rows = materialize(sized.drop("size", "shard", "slot").withColumnRenamed(part, "size"), "shard-rows")
    keys = rows.select(F.col(k).alias("k"), F.col(m).alias("m"), "size")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per = max(1, -(-total // (shards * part_bytes)))
    cuts, _, _ = find_splitters(keys, shards, tolerance)
    shard = _shard_of(k, m, cuts)
    placed = rows.withColumn("shard", shard).withColumn(part, F.col("shard") * per + F.pmod(F.xxhash64(k, m), F.lit(per)).cast("int"))
    earlier = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    counts = placed.groupBy("shard", part).agg(F.count(F.lit(1)).alias("n"))
    offsets = materialize(counts.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before)), "offsets")
    moved = placed.repartitionById(shards * per, F.col(part))
    slot = F.row_number().over(Window.partitionBy(part).orderBy(k, m)).cast("long") - 1
    local = moved.withColumn("slot", slot)
    joined = local.join(F.broadcast(offsets) if shards * per <= BROADCAST_PARTS else offsets, part)
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (k, m, "size")]
    return joined.select(*kept, "size", "shard", (F.col(before) + F.col("slot")).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the law ``bytes``. Groups of equal texts are cut anywhere: one may hold more
    than a shard, and the law leaves no room for it."""
    out = histogram_sort(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "size",
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
