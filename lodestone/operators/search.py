"""Semantic search: an exact scan, lexical boosts, a score window, top-k.

The scan is narrow: it computes scores from vectors and paths alone; texts are joined
back to the rows that are left. A batch of queries is scored in numpy blocks. Hits
tie-break on ``passage_id``, the order of the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vector as V

#: Fixed value: what a filename that covers the whole query adds.
FILENAME_BOOST = 0.05


def with_lexical(passages: DataFrame) -> DataFrame:
    """Adds the token sets of each passage's file name and folders. Kept with an index,
    they spare each search cutting all paths anew."""
    return passages.withColumns(
        {"filename_tokens": F.array_distinct(T.tokens(T.basename(F.col("file")))), "folder_tokens": F.array_distinct(T.tokens(T.dirname(F.col("file"))))}
    )


def _boosted(scored: DataFrame, query: Column, folder_boost: float) -> DataFrame:
    rows = scored if "filename_tokens" in scored.columns else with_lexical(scored)
    rows = rows.withColumn("_wanted", F.array_distinct(T.tokens(query)))
    name = V.coverage(F.col("_wanted"), F.col("filename_tokens")) * FILENAME_BOOST
    folder = V.coverage(F.col("_wanted"), F.col("folder_tokens")) * F.lit(float(folder_boost))
    rows = rows.withColumns({"filename_boost": name, "folder_path_boost": folder})
    return rows.select("passage_id", "file", "score", "filename_boost", "folder_path_boost", (F.col("score") + F.col("filename_boost") + F.col("folder_path_boost")).alias("ranking"))


def window_floor(rows: DataFrame, score_window: float | None) -> DataFrame:
    """One row: the similarity of the best-ranked hit less the window."""
    width = max(0.0, min(1.0, 1.0 if score_window is None else score_window))
    # of whole rows, so that this reads the very exchange that its caller reads
    best = F.max_by(F.struct(*rows.columns), F.struct("ranking", (-F.col("passage_id")).alias("p")))
    return rows.agg((F.coalesce(best["score"], F.lit(0.0)) - width).alias("floor"))


def scores_of(vectors: Column, query_vector: list[float]) -> Column:
    """Dot products with one vector, by batches. A vector that is missing or of another
    length is an error, as an index that has one is damaged."""
    q = np.array(query_vector, np.float64)

    def run(batch: pa.Array) -> pa.Array:
        return pa.array(_matrix(batch, len(q)) @ q)

    return F.arrow_udf(run, "double")(vectors)


def _matrix(vectors: pa.Array, dimension: int | None = None) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    if not len(vectors):
        return np.zeros((0, dimension or 0))
    sizes = pc.list_value_length(vectors)
    wanted = dimension if dimension is not None else sizes[0].as_py()
    flat = vectors.flatten()
    if vectors.null_count or flat.null_count or pc.any(pc.not_equal(sizes, wanted)).as_py():
        raise ValueError(f"a passage has no vector of length {wanted}")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), wanted)


def search(
    passages: DataFrame,
    query_vector: Column | list[float],
    query: str,
    top_k: int = 10,
    min_score: float = 0.5,
    score_window: float | None = None,
    folder_path_boost: float = 0.0,
    file: str | None = None,
) -> DataFrame:
    """The best passages of an index (passage_id, file, embedding) for one query.

    The threshold and the window look at the pure similarity; ranking adds the boosts.
    The window hangs on the best-ranked hit, which need not be the most similar.
    """
    rows = passages.filter(F.col("file") == file) if file else passages
    similarity = scores_of(F.col("embedding"), query_vector) if isinstance(query_vector, list) else V.dot(query_vector, F.col("embedding"))
    lexical = [c for c in ("filename_tokens", "folder_tokens") if c in passages.columns]
    scored = rows.select("passage_id", "file", *lexical, similarity.alias("score")).filter(F.col("score") >= min_score)
    # vectors are read once: what passes the threshold goes through one exchange that both
    # the window's floor and the ranking read
    ranked = _boosted(scored, F.lit(query), folder_path_boost).repartition("passage_id")
    kept = ranked.join(F.broadcast(window_floor(ranked, score_window)), F.col("score") >= F.col("floor")).drop("floor")  # one row
    best = kept.orderBy(F.desc("ranking"), "passage_id").limit(top_k)
    return best.select(
        "passage_id",
        "file",
        F.least(F.lit(1.0), F.col("ranking")).alias("score"),
        F.col("score").alias("semantic_score"),
        F.least(F.lit(1.0), F.col("ranking")).alias("ranking_score"),
        "filename_boost",
        "folder_path_boost",
    )


#: Up to so many hits look up the wide table as a broadcast.
BROADCAST_HITS = 100_000


def fetch(hits: DataFrame, passages: DataFrame, most: int = 1000) -> DataFrame:
    """Hits, of which there are at most ``most``, with all columns of their passages."""
    wide = passages.drop("embedding", "file")
    return wide.join(F.broadcast(hits) if most <= BROADCAST_HITS else hits, "passage_id")


def scores_per_note(passages: DataFrame, query_vector: Column) -> DataFrame:
    """The best similarity of each note, without a threshold. A best of 0 stays 0."""
    return passages.select("file", V.dot(query_vector, F.col("embedding")).alias("score")).groupBy("file").agg(F.max("score").alias("score"))


_HITS = "query_id long, passage_id long, score double"
_HIT_TYPE = pa.schema([("query_id", pa.int64()), ("passage_id", pa.int64()), ("score", pa.float64())])


#: Queries in a block and passages in a pack: their scores take 64 MB.
QUERY_BLOCK, PACK = 4096, 2048
#: Passages in a stripe: what a task holds.
STRIPE_ROWS = 262_144


class _Best:
    """The ``k`` best passages so far of each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, min_score: float, exclude_same: bool):
        self.ids, self.vectors, self.k, self.min_score, self.exclude_same = ids, vectors, k, min_score, exclude_same
        self.found: pa.Table = _HIT_TYPE.empty_table()
        self.bar = np.full(len(ids), -np.inf)

    def add(self, passage_ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(passage_ids) or not len(self.ids):
            return
        scores = np.round(self.vectors @ vectors.T, 12)
        if self.exclude_same:
            scores[self.ids[:, None] == passage_ids] = -np.inf
        scores[scores < self.min_score] = -np.inf
        k = min(self.k, len(passage_ids))
        bar = np.maximum(self.bar, np.partition(scores, len(passage_ids) - k, axis=1)[:, len(passage_ids) - k])
        i, j = np.nonzero((scores >= bar[:, None]) & np.isfinite(scores))
        old = self.found
        row = np.concatenate([old["query_id"].to_numpy(), i])  # the query's place in the block
        passage, score = np.concatenate([old["passage_id"].to_numpy(), passage_ids[j]]), np.concatenate([old["score"].to_numpy(), scores[i, j]])
        order = np.lexsort((passage, -score, row))
        row, passage, score = row[order], passage[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        keep = place < self.k
        self.bar[row[place == self.k - 1]] = score[place == self.k - 1]
        self.found = pa.table([row[keep], passage[keep], score[keep]], schema=_HIT_TYPE)

    def hits(self) -> pa.Table:
        return pa.table([self.ids[self.found["query_id"].to_numpy()], self.found["passage_id"], self.found["score"]], schema=_HIT_TYPE)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def block_top_k(passages: DataFrame, queries: DataFrame, top_k: int, min_score: float = -2.0, block: int = QUERY_BLOCK, exclude_same: bool = False) -> DataFrame:
    """query_id, passage_id, score, rank: exact top-k of many queries.

    Up to one block of queries goes to every partition of passages as it is (1 MB at 64
    dimensions). More are packed into blocks, and every block of queries meets every
    stripe of passages in a task of a grid: neither side is gathered, and there are as
    many stripes as keep each at ``STRIPE_ROWS``. Scores are matrix products; a task
    keeps k rows per query.
    """
    asked, held = queries.select("query_id", "embedding"), passages.select("passage_id", "embedding")
    few = asked.limit(block + 1).toArrow()
    met = _meet_one_block(held, few, top_k, min_score, exclude_same) if few.num_rows <= block else _meet_grid(held, asked, top_k, min_score, block, exclude_same)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "passage_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def _meet_one_block(held: DataFrame, asked: pa.Table, top_k: int, min_score: float, exclude_same: bool) -> DataFrame:
    few = asked.combine_chunks()
    ids = _ids(few["query_id"].combine_chunks())
    vectors = _matrix(few["embedding"].combine_chunks()) if len(ids) else np.zeros((0, 0))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(ids, vectors, top_k, min_score, exclude_same)
        for b in batches:
            for at in range(0, b.num_rows, PACK):
                part = b.slice(at, PACK)
                best.add(_ids(part.column(0)), _matrix(part.column(1), vectors.shape[1] if len(ids) else None))
        yield from best.hits().to_batches()

    return held.mapInArrow(meet, _HITS)


def _meet_grid(held: DataFrame, asked: DataFrame, top_k: int, min_score: float, block: int, exclude_same: bool) -> DataFrame:
    def packer(rows: int):  # noqa: ANN202
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    part = b.slice(at, rows)
                    vectors = _matrix(part.column(1)).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([_ids(part.column(0)).tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary()), pa.array([part.num_rows], pa.int32())], ["ids", "vectors", "n"])

        return pack

    packed = "ids binary, vectors binary, n int"
    width = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = held.count()
    blocks = max(1, -(-asked.count() // block))
    stripes = max(1, min(-(-n // PACK), max(-(-n // STRIPE_ROWS), -(-width // blocks))))
    left = asked.mapInArrow(packer(block), packed).withColumn("b", F.pmod(F.xxhash64("ids"), F.lit(blocks)).cast("int"))
    right = held.mapInArrow(packer(PACK), packed)

    def meet(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        read = lambda r: (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.float32).reshape(r["n"], -1).astype(np.float64))
        out = []
        for q in (r for r in rows if r["q"]):
            best = _Best(*read(q), top_k, min_score, exclude_same)
            for p in (r for r in rows if not r["q"]):
                best.add(*read(p))
            out.append(best.hits())
        return pa.concat_tables(out) if out else _HIT_TYPE.empty_table()

    grid_q = left.select("ids", "vectors", "n", F.lit(True).alias("q"), F.col("b"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("s"))
    dealt = right.withColumn("s", F.pmod(F.xxhash64("ids"), F.lit(stripes)).cast("int"))
    grid_p = dealt.select("ids", "vectors", "n", F.lit(False).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "s")
    return grid_q.unionByName(grid_p).groupBy("b", "s").applyInArrow(lambda t: meet(t.select(["ids", "vectors", "n", "q"])), _HITS)
