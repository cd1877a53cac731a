"""What the word taggers share: bounded training samples, and tagging of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import text_slices
from lodestone.llm.crf import Model, marginals, words_of
from lodestone.shipping import ship

_SPAN = 100


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, mod ``by``."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % by


def bounded(rows: DataFrame, label: str, per_label: int, most_labels: int, text: str | None = None, id_column: str = "doc_id") -> tuple[DataFrame, dict]:
    """At most ``per_label`` rows of each of the ``most_labels`` most frequent labels,
    and how many distinct rows (about) each of these labels has.

    Rows are taken by a hash of id and text: first those under a threshold that about
    ``per_label`` distinct rows pass, then, should repeated rows make them more, the
    first by that hash. Columns: label (string), the id, and the text if it is given.
    """
    keys = [F.col(id_column)] + ([F.col(text)] if text else [])
    named = rows.select(F.col(label).cast("string").alias("label"), *keys, F.xxhash64(*keys, F.lit(17)).alias("_h"))
    found = named.groupBy("label").agg(F.approx_count_distinct("_h").alias("n")).orderBy(F.desc("n"), "label").limit(most_labels).collect()
    counts = {r.label: r.n for r in found}
    shares = F.create_map(*[F.lit(x) for v, n in counts.items() for x in (v, min(1.0, per_label / n))]) if counts else F.create_map(F.lit(""), F.lit(0.0))
    near = named.filter(F.pmod("_h", F.lit(1_000_000)) < F.coalesce(F.try_element_at(shares, F.col("label")), F.lit(0.0)) * 1_000_000)
    first = F.row_number().over(Window.partitionBy("label").orderBy("_h"))
    return near.withColumn("_n", first).filter(F.col("_n") <= per_label).drop("_n", "_h"), counts


def word_spans(docs: DataFrame, most: int) -> list[tuple[str, list[str]]]:
    """(label, words) of each row (label, text) for training: all words, or ``most`` of
    them in spans spread evenly over the whole text. For bounded samples only."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, 1):
                words, offsets, _, _ = words_of(b.column(1))
                names = words.dictionary.to_pylist()
                place = words.indices.to_numpy()
                out = []
                for s, e in zip(offsets[:-1], offsets[1:], strict=True):
                    spans = max(1, most // _SPAN)
                    starts = [s] if e - s <= most else [s + (e - s - _SPAN) * i // max(1, spans - 1) for i in range(spans)]
                    out.append(" ".join(names[i] for a in starts for i in place[a : e if e - s <= most else a + _SPAN]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["label", "words"])

    ship(docs.sparkSession)
    rows = docs.select("label", "text").mapInArrow(cut, "label string, words string").collect()
    # by content, so that the order in which tasks end doesn't matter
    return sorted((r.label, r.words.split(" ")) for r in rows if r.words)


def tag(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all words of ``texts``, each text's offset into them, and each
    word's first code point in its text and its length."""
    words, offsets, first, low = words_of(texts)
    scores = model.emissions(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
    sizes = np.diff(words.dictionary.buffers()[1] and np.frombuffer(words.dictionary.buffers()[1], np.int64, count=len(words.dictionary) + 1))[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
    p = marginals(scores, offsets, model.transitions)
    _, off, data = low.buffers()
    off = np.frombuffer(off, np.int64, count=len(low) + 1)
    raw = np.frombuffer(data, np.uint8)[: off[-1]] if data is not None and off[-1] else np.zeros(0, np.uint8)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    text = np.repeat(np.arange(len(low)), np.diff(offsets))
    return p, offsets, points[first] - points[off[text]], points[first + sizes] - points[first]


def runs(marks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal marks within texts: first word, last word, and each text's
    offset into the runs."""
    if not len(marks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    new = np.concatenate([[True], marks[1:] != marks[:-1]])
    new[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(marks)) - 1
    return starts, ends, np.searchsorted(starts, offsets)
