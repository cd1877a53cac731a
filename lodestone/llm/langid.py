"""Language identification of words and texts by a linear-chain CRF.

The model is fitted on a bounded sample of the table's own labelled texts: about
``per_label`` documents of each of the ``most_labels`` commonest languages, of each at
most ``words`` words in spans spread over the text. Half of the training sequences join spans of documents in
different languages, so that transitions learn how code-switched text changes.
A word's label is found by forward-backward over the whole text. A text's language
is the one with most probability over all words; the score is its share.

Cases: a null text, or one without a letter, is ``und`` with score 0; documents
without a language or an id teach nothing; with no labelled document every text
with a letter is ``und`` too; with one language it is that; repeated rows are
judged alike; very long texts are judged whole; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.llm.crf import Model, fit
from lodestone.llm.tagging import bounded, remainder, runs, tag, word_spans
from lodestone.shipping import ship

UNKNOWN = "und"
RESULT = "lang_pred string, score double, spans array<struct<lang: string, start: long, length: long>>"
_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))


def train(docs: DataFrame, per_label: int = 400, words: int = 300, sequences: int = 1600, most_labels: int = 64, seed: int = 7) -> Model | None:
    """Learn from ``text`` and non-null ``lang`` of ``docs``."""
    sample, _ = bounded(docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL"), "lang", per_label, most_labels, "text")
    spans = word_spans(sample, words)
    labels = sorted({label for label, _ in spans})
    if not labels:
        return None
    types = {w: i for i, w in enumerate(sorted({w for _, ws in spans for w in ws}))}
    place = [(labels.index(label), np.array([types[w] for w in ws])) for label, ws in spans]
    by = [[p for k, p in place if k == i] for i in range(len(labels))]
    seen = np.stack([np.bincount(np.concatenate(p), minlength=len(types)) for p in by])
    share = seen / np.maximum(seen.sum(axis=0), 1)
    lexicons = {i: np.flatnonzero((seen[i] >= 3) & (share[i] >= 0.9)) for i in range(len(labels))}
    rng = np.random.default_rng(seed)
    rows, tags = [], []
    for turn in range(sequences):
        k, parts = turn % len(labels), []
        for _ in range(1 if turn % 2 else int(rng.integers(2, 5))):
            own = by[k][rng.integers(len(by[k]))]
            size = 100 if turn % 2 else int(rng.integers(5, 40))
            at = rng.integers(max(1, len(own) - size + 1))
            parts.append((k, own[at : at + size]))
            k = (k + 1 + int(rng.integers(max(1, len(labels) - 1)))) % len(labels)
        rows.append(np.concatenate([p for _, p in parts]))
        tags.append(np.concatenate([np.full(len(p), k) for k, p in parts]))
    return fit(labels, pa.array(list(types), pa.large_string()), rows, tags, lexicons)


def predict(texts: pa.Array, model: Model | None) -> pa.StructArray:
    """lang_pred, score and the spans (code points) of each language in each text."""
    n = len(texts)
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if model is None:
        return pa.StructArray.from_arrays([pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array([[]] * n, _SPANS)], ["lang_pred", "score", "spans"])
    p, offsets, start, length = tag(texts, model)
    counts = np.diff(offsets)
    total = np.zeros((n, p.shape[1]))
    full = np.flatnonzero(counts)
    if len(full):
        total[full] = np.add.reduceat(p, offsets[:-1][full], axis=0)
    share = total / np.maximum(counts, 1)[:, None]
    best = share.argmax(axis=1)
    score = np.where(lettered, np.minimum(share[np.arange(n), best], 1.0), 0.0)
    names = np.array(model.labels, object)
    first, last, at = runs(p.argmax(axis=1), offsets)
    lang = pa.array(names[p[first].argmax(axis=1)] if len(first) else [], pa.string())
    spans = pa.StructArray.from_arrays([lang, pa.array(start[first]), pa.array(start[last] + length[last] - start[first])], fields=list(_SPANS.value_type))
    pred = pa.array(np.where(lettered, names[best], UNKNOWN), pa.string())
    return pa.StructArray.from_arrays([pred, pa.array(score), pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)], ["lang_pred", "score", "spans"])


def identify(docs: DataFrame, model: Model | None, text: str = "text", column: str = "_lang") -> DataFrame:
    """``docs`` with a struct of lang_pred, score and spans."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            parts = [predict(p, shared.value) for p in array_slices(b)]
            yield pa.concat_arrays(parts) if len(parts) != 1 else parts[0]

    return docs.withColumn(column, F.arrow_udf(run, RESULT).asNondeterministic()(text))


def array_slices(texts: pa.Array, most: int = 4 << 20) -> list[pa.Array]:
    """``texts`` in runs of about ``most`` bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a] or [texts]


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs.filter(~held).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "_lang.lang_pred", "_lang.score", F.size("_lang.spans").alias("n_spans"))
