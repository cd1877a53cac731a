"""Exact top-k inner products by no-random-access aggregation, in blocks.

Vectors become integers, floor(64 * x). Queries are dealt into blocks, candidates
into stripes; each (block, stripe) is a task that runs through its stripe slice by
slice. A slice is kept as one sorted list of (value, candidate) for each dimension.
For all queries of a block together:

1. Each list is read from both ends: a query needs the end where its weight gains most.
   Cursors move on together, each past the entries within a common share of its list's
   range. What has been read is all that is known of a candidate.
2. A candidate that has not been met in a list loses that share of the list's range
   there at least, and all of it at most. With what it loses where it was met, that
   bounds its score for each query from above and below (sums for all queries at once
   are one matrix product of the weights and of what has been read).
3. Who is bounded under the k-th best lower bound (or under the k-th score known from
   slices before) cannot qualify. A query stops when nearly all cannot; a candidate
   with a bound equal to the bar still can, so ties are kept.
4. When all queries have stopped, reading goes on until the lists have those that still
   can, and their scores are resolved from what has been read.

Cases: vectors that are null or hold a null or non-finite component take no part;
an empty vector or a shorter one counts as padded with zeros; rows with equal ids
are rows of their own (a row's own is left out by place, not by id); ties go to
the smaller id; fewer candidates than k give all; a table without rows gives none.
A null id takes no part. Any finite component is taken exactly, however large; a score
beyond 64 bits becomes the nearest 64-bit number, and is ranked as that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, shuffle_width, table

_PACK = "is_query boolean, block long, ids binary, uids binary, vals binary, code string, dim int"
_PACK_SCHEMA = pa.schema(
    [("is_query", pa.bool_()), ("block", pa.int64()), ("ids", pa.binary()), ("uids", pa.binary()), ("vals", pa.binary()), ("code", pa.string()), ("dim", pa.int32())]
)
_OUT = "query_uid long, query_id long, vec_id long, score long"
_OUT_SCHEMA = pa.schema([("query_uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
#: Shares of the lists' ranges at which bounds are looked at.
SHARES = (0.45, 0.55, 0.65, 0.8, 1.0)
#: Partitions of the grid's shuffle, at most.
MOST_TASKS = 100_000
#: Queries whose bounds are looked at together.
_TOGETHER = 512
#: Vectors with components beyond 32 bits are packed as they came.
_RAW = "<f8"


def _packed(is_query: bool, block: int, ids: np.ndarray, uids: np.ndarray, x: np.ndarray) -> tuple:
    most = np.abs(x).max(initial=0)
    code = next((c for c, top in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1)) if most * 64 + 1 <= top), _RAW) if most < 2**40 else _RAW
    vals = x if code == _RAW else np.floor(64 * x)
    return is_query, block, ids.astype("<i8").tobytes(), uids.astype("<i8").tobytes(), vals.astype(code).tobytes(), code, x.shape[1]


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row places, vectors) of a batch's finite vectors, by their length."""
    vectors = batch.column(1).cast(pa.list_(pa.float64()))
    flat = vectors.values.to_numpy(zero_copy_only=False) if vectors.values.null_count == 0 else np.where(pc.is_null(vectors.values).to_numpy(zero_copy_only=False), np.nan, vectors.values.to_numpy(zero_copy_only=False))
    offsets = vectors.offsets.to_numpy()
    there = ~(vectors.is_null().to_numpy(zero_copy_only=False) | batch.column(0).is_null().to_numpy(zero_copy_only=False))
    lengths = np.diff(offsets)
    for dim in np.unique(lengths[there]):
        rows = np.flatnonzero(there & (lengths == dim))
        block = flat[offsets[rows][:, None] + np.arange(dim)]
        fine = np.isfinite(block).all(axis=1)
        yield rows[fine], block[fine]


class Lists:
    """A slice's sorted lists, cursors from both ends of each, and what they have read.

    ``lost`` has, for each list from its high end and then for each from its low end, how
    far each candidate that was met is from that end; ``met`` marks these.
    """

    def __init__(self, vectors: np.ndarray, kind: type = np.float64):
        self.size, self.dim = vectors.shape
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(vectors, order, axis=0).T, dtype=np.float64)
        self.owners = np.ascontiguousarray(order.T, dtype=np.intp)
        self.whole = vectors.dtype.kind == "i"
        low, high = (self.values[:, 0], self.values[:, -1]) if self.size else (np.zeros(self.dim),) * 2
        self.ends = np.concatenate([high, -low])  # the best that a weight of one, and of minus one, can gain
        self.range = np.concatenate([high - low, high - low])
        self.at = np.zeros(2 * self.dim, np.intp)
        self.lost, self.met = np.zeros((2 * self.dim, self.size), kind), np.zeros((2 * self.dim, self.size), kind)
        #: What a candidate loses at least in each list where it has not been met.
        self.least = np.zeros(2 * self.dim)
        self.read = 0

    def advance(self, share: float) -> None:
        """Read on past all entries within a share of the lists' ranges."""
        n, least = self.size, self.range * share
        self.least = np.floor(least) if self.whole else least
        for i in range(2 * self.dim):
            d, reach = i % self.dim, self.least[i]
            values = self.values[d]
            if share >= 1:
                to = n
            elif i < self.dim:
                to = n - int(np.searchsorted(values, values[-1] - reach, "left"))
            else:
                to = int(np.searchsorted(values, values[0] + reach, "right"))
            if to > self.at[i]:
                part = slice(n - to, n - self.at[i]) if i < self.dim else slice(self.at[i], to)
                who = self.owners[d, part]
                self.lost[i, who] = values[-1] - values[part] if i < self.dim else values[part] - values[0]
                self.met[i, who] = 1
                self.read += to - self.at[i]
                self.at[i] = to


class Queries:
    """The queries of a block over a slice's lists."""

    def __init__(self, q: np.ndarray, lists: Lists):
        self.lists = lists
        self.weights = np.concatenate([np.maximum(q, 0), np.maximum(-q, 0)], axis=1).astype(lists.lost.dtype)
        self.best = (self.weights * lists.ends).sum(axis=1, dtype=np.float64)

    def bound(self, rows: np.ndarray, unmet: np.ndarray) -> np.ndarray:
        """Scores of all candidates for some queries, if each loses ``unmet`` in a list
        where it has not been met."""
        x, w = self.lists, self.weights[rows]
        return (self.best[rows] - w.astype(np.float64) @ unmet)[:, None] - w @ (x.lost - unmet[:, None].astype(x.lost.dtype) * x.met)

    def upper(self, rows: np.ndarray) -> np.ndarray:
        return self.bound(rows, self.lists.least)

    def lower(self, rows: np.ndarray) -> np.ndarray:
        return self.bound(rows, self.lists.range)


def contenders(q: np.ndarray, lists: Lists, k: int, floor: np.ndarray | None = None, slack: float = 0.0) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """For each query who of a slice may be among its k best, and their scores; and how
    many entries were read until the last query stopped. ``floor``: scores that k known
    candidates reach; ``slack``: what rounding may take from a bound (none where all are
    integers)."""
    all_ = Queries(q, lists)
    floor = np.full(len(q), -np.inf) if floor is None else floor
    few: list[np.ndarray] = [np.arange(lists.size)] * len(q)
    active = np.arange(len(q))
    for share in SHARES:
        lists.advance(share)
        going = []
        for at in range(0, len(active), _TOGETHER):
            rows = active[at : at + _TOGETHER]
            bar = floor[rows]
            if lists.size > k and not np.isfinite(bar).all():
                bar = np.maximum(bar, np.partition(all_.lower(rows), lists.size - k, axis=1)[:, lists.size - k])
            can = all_.upper(rows) >= (bar - slack)[:, None]
            stops = (can.sum(axis=1) <= max(2 * k, lists.size // 16)) | (share == SHARES[-1])
            for i in np.flatnonzero(stops):
                few[rows[i]] = np.flatnonzero(can[i])
            going.append(rows[~stops])
        active = np.concatenate(going) if going else active
        if not len(active):
            break
    read = lists.read
    lists.advance(SHARES[-1])
    scores = [all_.best[i] - (all_.weights[i].astype(np.float64) @ lists.lost[:, few[i]]) for i in range(len(q))]
    return few, scores, read


def _top_of(t: pa.Table, k: int, slice_rows: int) -> pa.Table:
    """The k best of a stripe for each query of a block."""
    sides: dict[bool, list] = {True: [], False: []}
    dim = max(t["dim"].to_pylist(), default=0)
    large = pc.any(pc.equal(t["code"], _RAW)).as_py()
    for r in t.to_pylist():
        ids, uids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["uids"], "<i8")
        own = np.frombuffer(r["vals"], r["code"]).reshape(len(ids), r["dim"])
        if large:  # multiples of 1/64, exactly
            own = np.where(np.abs(own) < 2**46, np.floor(64 * np.clip(own, -(2.0**46), 2.0**46)) / 64, own) if r["code"] == _RAW else own / 64
        vals = np.zeros((len(ids), dim), own.dtype)
        vals[:, : r["dim"]] = own
        sides[r["is_query"]].append((ids, uids, vals))
    if not sides[True] or not sides[False]:
        return _OUT_SCHEMA.empty_table()
    (qid, quid, q), (cid, cuid, c) = (tuple(np.concatenate(x) for x in zip(*sides[s], strict=True)) for s in (True, False))
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(dim, 1) if not large else np.inf
    exact = reach < 2**51
    q = q.astype(np.float64)
    if not exact:  # bounds in shares of the largest components, scores in whole numbers
        unit = 1.0 if large else 64.0
        q, c = q / unit, c / unit
        q_most, c_most = (max(float(np.abs(x).max(initial=0)), 1e-300) for x in (q, c))
    # one more than k: the query's own row may be among them
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    floor = np.full(len(q), -np.inf)
    for at in range(0, len(c), slice_rows):
        part, part_ids, part_uids = c[at : at + slice_rows], cid[at : at + slice_rows], cuid[at : at + slice_rows]
        lists = Lists(part, np.float32 if reach < 2**22 else np.float64) if exact else Lists(part / c_most)
        if exact:
            few, sums, _ = contenders(q, lists, k + 1, floor)
        else:
            few, sums, _ = contenders(q / q_most, lists, k + 1, slack=(dim + 1) ** 2 * 2.0**-48)
        for i, found in enumerate(few):
            scores = np.rint(sums[i]).astype(np.int64) if exact else np.array([_whole_product(q[i], v) for v in part[found]], np.int64)
            other = part_uids[found] != quid[i]
            ids = np.concatenate([best[i][0], part_ids[found[other]]])
            scores = np.concatenate([best[i][1], scores[other]])
            order = np.lexsort((ids, ~scores))[:k]  # ~x falls as x rises, for the least number too
            best[i] = ids[order], scores[order]
            if len(order) == k:
                floor[i] = best[i][1][-1]
    sizes = [len(b[0]) for b in best]
    return pa.table([np.repeat(quid, sizes), np.repeat(qid, sizes), np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best])], schema=_OUT_SCHEMA)


def _whole_product(q: np.ndarray, v: np.ndarray) -> int:
    """The inner product of two vectors in 64ths, as a 64-bit number or the nearest."""
    whole = lambda x: int(x) * 64 if abs(x) >= 2**53 else int(64 * x)
    return max(-(2**63), min(2**63 - 1, sum(whole(a) * whole(b) for a, b in zip(q.tolist(), v.tolist(), strict=True))))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", queries_in_block: int = 32768, stripe_rows: int = 262144, slice_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for every row
    whose id is divisible by ``every``.

    Candidates are copied once for each block of queries, so blocks are as large as a
    task's memory takes (at 64 dimensions, 2 MB). Small tables get smaller stripes, so
    that all cores have one.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    sizes = rows.agg(F.count("id").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).first()
    blocks = max(1, -(-sizes.q // queries_in_block))
    wide = max(-(-sizes.n // stripe_rows), -(-shuffle_width(vectors.sparkSession) // blocks))
    stripes = max(1, min(-(-sizes.n // min(slice_rows, stripe_rows)), wide))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, turn, out = TaskContext.get().partitionId() << 40, TaskContext.get().partitionId(), []
        for b in batches:
            for at, vals in _matrices(b):
                ids = b.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64)
                uids = uid + at
                for s in range(0, len(ids), 1024):
                    out.append(_packed(False, turn % stripes, ids[s : s + 1024], uids[s : s + 1024], vals[s : s + 1024]))
                    turn += 1
                asked = np.flatnonzero(ids % every == 0)
                where = (uids[asked] * 0x9E3779B1 >> 7) % blocks
                for block in np.unique(where):
                    own = asked[where == block]
                    out.append(_packed(True, int(block), ids[own], uids[own], vals[own]))
            uid += b.num_rows
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PACK_SCHEMA, strict=True)], schema=_PACK_SCHEMA)
                out = []

    packs = materialize(rows.mapInArrow(pack, _PACK), "topk-packs")
    other = F.when(F.col("is_query"), F.sequence(F.lit(0), F.lit(stripes - 1))).otherwise(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = packs.withColumn("other", F.explode(other))
    dealt = dealt.withColumn("task", F.when(F.col("is_query"), F.col("block") * stripes + F.col("other")).otherwise(F.col("other") * stripes + F.col("block")))
    # by number: the packs are small, and merged into few tasks they would keep few cores busy
    dealt = dealt.repartition(min(blocks * stripes, MOST_TASKS), "task")
    found = dealt.groupBy("task").applyInArrow(lambda t: _top_of(t.select(_PACK_SCHEMA.names), k, slice_rows), _OUT)
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
