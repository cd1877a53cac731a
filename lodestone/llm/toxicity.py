"""Toxic spans and document scores by a linear-chain CRF.

Labels are of documents, so words get theirs first: in toxic training documents a
word is toxic if it, its first four or its first five letters stand in many more
toxic than other documents; all other words are not. The chain is fitted on these
words and their neighbours. Forward-backward over a whole text gives each word's
probability of being toxic; words of one half or more make the offending spans. A
document's score is a logistic function of the sum, the largest and the mean of
these probabilities (sum and mean of squares), fitted on the training documents and weighted by how common
each label is.

The chain has no lexicon of these words: it must tell them by their own features and
their neighbours, so it also tags words that the list lacks. The model is fitted on a
bounded sample, less near copies in it: at most ``per_label`` documents of each label,
of each at most ``words`` words in spans spread over the text. All of the sample is
learned from.

Cases: null and empty texts, or texts without a word, get the score of no toxic
word; labels that are null or have no document teach nothing; with one label or
none every score is that label's share (0 if there is none); repeated rows are
scored alike; very long texts are scored whole; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.llm.crf import Model, fit, marginals
from lodestone.llm.langid import array_slices
from lodestone.llm.tagging import bounded, remainder, runs, tag, word_spans
from lodestone.shipping import ship

RESULT = "score double, spans array<struct<start: long, length: long, probability: double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("probability", pa.float64())]))


def _units(word: str) -> set[str]:
    low = word.lower()
    return {low, *(f"{low[:k]}*" for k in (4, 5) if len(low) >= k)}


def without_copies(spans: list[tuple[str, list[str]]], width: int = 5, most: float = 0.3) -> list[tuple[str, list[str]]]:
    """The sample less near copies: rows of which more than ``most`` of the word runs
    stand in rows before them. Else a copied text's words would seem common."""
    seen: set[tuple[str, ...]] = set()
    kept = []
    for label, words in spans:
        runs_ = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
        if len(runs_ & seen) <= most * len(runs_):
            kept.append((label, words))
        seen |= runs_
    return kept


def toxic_words(spans: list[tuple[str, list[str]]], lift: float = 8.0, least: float = 0.01) -> set[str]:
    """Words that they themselves or, if they are rare, a unit of theirs tie to toxic documents."""
    docs = {"0": [], "1": []}
    for label, words in spans:
        docs[label].append(set().union(*map(_units, set(words))))
    seen = {}
    for label, rows in docs.items():
        for units in rows:
            for u in units:
                seen.setdefault(u, [0, 0])[int(label)] += 1
    n0, n1 = len(docs["0"]), len(docs["1"])
    ties = {u: (b + 0.5) / (n1 + 1) / ((a + 0.5) / (n0 + 1)) >= lift for u, (a, b) in seen.items() if b >= max(3, least * n1)}

    def is_tied(word: str) -> bool:
        a, b = seen[word.lower()]
        if a + b >= 10:  # often enough to speak for itself
            return ties.get(word.lower(), False)
        return any(ties.get(u, False) for u in _units(word))

    return {w for _, words in spans for w in set(words) if is_tied(w)}


def _summary(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: 1, log of 1 + the sum, the largest and the mean probability.

    Sum and mean are of squares: else the many words of a long text that are hardly
    suspect at all would add up.
    """
    counts = np.diff(offsets)
    out = np.zeros((len(counts), 4))
    out[:, 0] = 1
    full = np.flatnonzero(counts)
    if len(full):
        total = np.add.reduceat(p * p, offsets[:-1][full])
        out[full, 1] = np.log1p(total)
        out[full, 2] = np.maximum.reduceat(p, offsets[:-1][full])
        out[full, 3] = total / counts[full]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton's method; ``ridge`` keeps separable data finite."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta += np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * beta)
    return beta


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1000, words: int = 300) -> Model | float:
    """Learn ``toxic`` of ``labels`` (doc_id, toxic) from the texts of ``docs``."""
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    sample, counts = bounded(marked, "toxic", per_label, 2)
    known = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(sample), "doc_id")  # at most per_label of each label
    spans = without_copies(word_spans(bounded(known, "label", per_label, 2, "text")[0], words))
    if len({label for label, _ in spans}) < 2:
        return float(counts.get("1", 0) / max(1, sum(counts.values())))
    bad = toxic_words(spans)
    types = {w: i for i, w in enumerate(sorted({w for _, ws in spans for w in ws}))}
    is_bad = np.array([w in bad for w in types])
    rows, tags = [], []
    for label, ws in spans:
        place = np.array([types[w] for w in ws])
        rows.append(place)
        tags.append((is_bad[place] & (label == "1")).astype(np.int64))
    model = fit(["clean", "toxic"], pa.array(list(types), pa.large_string()), rows, tags, {}, rounds=30)
    scores = model.emissions(pa.array(list(types), pa.large_string()))
    texts = [np.array([types[w] for w in ws]) for _, ws in spans]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x = _summary(marginals(scores[np.concatenate(texts)], offsets, model.transitions)[:, 1], offsets)
    y = np.array([label == "1" for label, _ in spans], float)
    weight = np.where(y == 1, counts["1"] / y.sum(), counts["0"] / (1 - y).sum())
    model.extra["beta"] = _logistic(x, y, weight / weight.mean())
    return model


def score(texts: pa.Array, model: Model | float) -> pa.StructArray:
    """The score and the offending spans (code points) of each text."""
    n = len(texts)
    if isinstance(model, float):
        return pa.StructArray.from_arrays([pa.array(np.full(n, model)), pa.array([[]] * n, _SPANS)], ["score", "spans"])
    p, offsets, start, length = tag(texts, model)
    p = p[:, 1]
    found = 1 / (1 + np.exp(-np.clip(_summary(p, offsets) @ model.extra["beta"], -30, 30)))
    marks = p >= 0.5
    first, last, at = runs(marks, offsets)
    toxic = marks[first] if len(first) else np.zeros(0, bool)
    at = np.concatenate([[0], np.cumsum(toxic)])[at]
    first, last = first[toxic], last[toxic]
    most = np.maximum.reduceat(p, first) if len(first) else np.zeros(0)
    spans = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(start[last] + length[last] - start[first]), pa.array(most)], fields=list(_SPANS.value_type))
    return pa.StructArray.from_arrays([pa.array(found), pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)], ["score", "spans"])


def score_documents(docs: DataFrame, model: Model | float, text: str = "text", column: str = "_toxicity") -> DataFrame:
    """``docs`` with a struct of score and spans."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            parts = [score(p, shared.value) for p in array_slices(b)]
            yield pa.concat_arrays(parts) if len(parts) != 1 else parts[0]

    return docs.withColumn(column, F.arrow_udf(run, RESULT).asNondeterministic()(text))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = train(docs, table(spark, sf_dir, "labels").filter(~held))
    found = score_documents(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), F.col("_toxicity.score").alias("score"), F.size("_toxicity.spans").alias("n_spans")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
