"""Embedding behind an interface: any model that maps texts to vectors fits.

No model weights come with the engine. :class:`HashingEmbedder` is deterministic and
needs none; it serves tests and shows the interface.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lodestone.functions import text as T
from lodestone.functions import vector as V

#: Fixed value: what a query's text begins with before it is embedded.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
#: Texts in a batch of the model, by kind.
BATCH = {"query": 8, "passage": 2, "phrase": 24}


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row of unit length per text."""


class HashingEmbedder:
    """Signed feature hashing of words and letter trigrams, L2-normalised."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                for part in (word, *(word[i : i + 3] for i in range(len(word) - 2))):
                    h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                    row[h % self.dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def in_batches(texts: list[str], size: int) -> Iterator[list[str]]:
    for at in range(0, len(texts), size):
        yield texts[at : at + size]


def embed_all(model: Embedder, texts: list[str], kind: str = "passage") -> np.ndarray:
    """Vectors of all texts, batch by batch; queries get their prefix."""
    named = [QUERY_PREFIX + t for t in texts] if kind == "query" else texts
    parts = [model.embed(b) for b in in_batches(named, BATCH[kind])]
    found = np.concatenate(parts) if parts else np.zeros((0, model.dimension), np.float32)
    if len(found) != len(texts):
        raise ValueError(f"the model returned {len(found)} of {len(texts)} vectors")
    return found


@lru_cache(maxsize=4)
def _loaded(kind: type, dimension: int) -> Embedder:
    """A worker process loads a model once."""
    return kind(dimension)


def embedder(kind: str = "passage", model: type = HashingEmbedder, dimension: int = 64):  # noqa: ANN201
    """A column function from text to ``array<float>``."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        loaded = _loaded(model, dimension)
        for b in batches:
            vectors = embed_all(loaded, [t or "" for t in b.to_pylist()], kind)
            yield pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))

    return F.arrow_udf(run, "array<float>")


def careful_embedder(kind: str = "passage", model: type = HashingEmbedder, dimension: int = 64):  # noqa: ANN201
    """A column function from text to a struct of ``embedding`` and ``error``. Where a
    batch fails its texts are tried one by one; what then fails has the error alone."""

    def one(loaded: Embedder, text: str) -> dict:
        try:
            return {"embedding": embed_all(loaded, [text], kind)[0].astype(np.float32), "error": None}
        except Exception as e:  # any failure of a model is that text's own
            return {"embedding": None, "error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        loaded = _loaded(model, dimension)
        for b in batches:
            texts = [t or "" for t in b.to_pylist()]
            try:
                found = [{"embedding": v, "error": None} for v in embed_all(loaded, texts, kind).astype(np.float32)]
            except Exception:  # one by one, to see which
                found = [one(loaded, t) for t in texts]
            yield pa.array(found, _CAREFUL)

    return F.arrow_udf(run, "embedding array<float>, error string")


_CAREFUL = pa.struct([("embedding", pa.list_(pa.float32())), ("error", pa.string())])


def embed_passages(passages: DataFrame, embed: object = None) -> DataFrame:
    """``passages`` with ``embedding`` and ``error``, of which one is null. ``embed``, a
    column function, gives a vector or a struct of these two."""
    made = (embed or careful_embedder())(T.embedding_text(F.col("file"), F.col("heading"), F.col("text")))
    found = passages.withColumn("_made", made)
    if isinstance(found.schema["_made"].dataType, ArrayType):
        found = found.withColumn("_made", F.struct(F.col("_made").alias("embedding"), F.when(F.col("_made").isNull(), "no vector").alias("error")))
    return found.withColumns({"embedding": F.col("_made.embedding"), "error": F.col("_made.error")}).drop("_made")


def phrase_key(c: Column) -> Column:
    return F.lower(T.trim(c))


def embed_phrases(candidates: DataFrame, known: DataFrame | None = None, embed: object = None) -> DataFrame:
    """phrase_key and vector: each distinct phrase that ``known`` lacks is embedded
    once, in the casing that comes first (by ``passage_id`` and ``pos``)."""
    keyed = candidates.withColumn("phrase_key", phrase_key(F.col("phrase")))
    distinct = keyed.groupBy("phrase_key").agg(F.min_by(T.trim(F.col("phrase")), F.struct("passage_id", "pos")).alias("phrase"))
    if known is not None:
        distinct = distinct.join(known.select("phrase_key"), "phrase_key", "left_anti")
    fresh = distinct.select("phrase_key", V.quantize((embed or embedder("phrase"))("phrase")).alias("vector"))
    return fresh if known is None else known.select("phrase_key", "vector").unionByName(fresh)


def phrase_dictionary(index: DataFrame) -> DataFrame:
    """phrase_key and vector of all candidates of an index; of several vectors of one
    phrase the last stands, in the order of files, passages and candidates."""
    spread = index.select("file", "chunk_no", F.posexplode("candidates").alias("pos", "c"))
    keyed = spread.select(phrase_key(F.col("c.phrase")).alias("phrase_key"), F.col("c.vector").alias("vector"), F.struct("file", "chunk_no", "pos").alias("at"))
    return keyed.groupBy("phrase_key").agg(F.max_by("vector", "at").alias("vector"))
