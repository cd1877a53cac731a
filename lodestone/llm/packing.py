"""Packing by bounded-space online best fit.

Each partition reads its documents once and keeps ``open_windows`` windows open.
A document's ids (and the id 0 that ends it) are cut into pieces of the window's
length and a rest. A whole piece is a sequence of its own; a rest goes to the open
window in which it leaves the least room. When it fits none, the fullest window is
emitted, the rest takes its place. At the end of a partition its open windows are
left over; they are merged in a tree: some partitions' leftovers are packed the
same way (best fit over whole windows' pieces), until one group remains. So every
step holds a bounded number of windows.

A sequence is padded to the window's length unless its fill is a power of two.

Cases: a null text is empty and has the ending id alone; long documents take as
many pieces as they need; repeated rows and equal ids are packed like others; a
table without rows gives none; further columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, table

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())]
)
#: The pattern by which byte-level BPE of this family splits a text; a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable bytes stand
    for themselves, the others are counted up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids (little-endian, unsigned 32 bits) of a text by a tokenizer's file.

    If the file is a plain byte-level BPE whose merges are numbered in order, its
    ranks are handed to a faster implementation of the same merges; texts that hold
    one of its special strings, and all other tokenizers, go the usual way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            self.fast = self._ranked(json.load(file))

    def _ranked(self, spec: dict) -> Callable[[str], list[int]] | None:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            return None
        import tiktoken

        letters, vocab = _byte_of(), model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab.get(a + b) for a, b in merges]
        if made != sorted(set(made)) or not all(c in vocab and vocab[c] < made[0] for c in letters):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if self.fast and not any(s in text for s in self.special):
            return np.array(self.fast(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker process keeps its encoder between tasks."""
    return Encoder(path)


class OpenWindows:
    """At most ``most`` open windows, by the room that they have."""

    def __init__(self, most: int, size: int):
        self.most, self.size, self.rooms, self.windows = most, size, [], {}
        self.next = 0

    def place(self, piece: tuple, length: int) -> list | None:
        """Put a piece, or several that belong together, into the window where they
        fit best; the fullest window, if it must go for that or has become full."""
        at = bisect_left(self.rooms, (length, -1))
        out = None
        if at == len(self.rooms):
            if len(self.rooms) >= self.most:
                out = self.windows.pop(self.rooms.pop(0)[1])
            room, key = self.size, self.next
            self.next += 1
            self.windows[key] = []
        else:
            room, key = self.rooms.pop(at)
        self.windows[key].append(piece)
        if room == length:
            full = self.windows.pop(key)
            return [*([out] if out else []), full]
        insort(self.rooms, (room - length, key))
        return [out] if out else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 1024, open_windows: int = 256, end_id: int = 0, id_column: str = "doc_id", fan_in: int = 32) -> DataFrame:
    """One row per piece: where it lies in its document and its sequence, and its ids.

    ``sequence_id`` is unique over all partitions, ``offset`` is gapless.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows, rows = encoder(path), OpenWindows(open_windows, window), []
        seq, bytes_held = TaskContext.get().partitionId() << 40, 0

        def emit(pieces: list[tuple], is_open: bool) -> None:
            nonlocal seq, bytes_held
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, ids, total, seq, offset, is_open))
                offset += len(ids) // 4
            seq += 1
            bytes_held += 4 * offset

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = (doc, start, ids[4 * start : 4 * (start + window)], total)
                    length = min(window, total - start)
                    if length == window:
                        emit([piece], False)
                    else:
                        for full in windows.place(piece, length) or ():
                            emit(full, False)
                if bytes_held > 8 << 20:
                    yield _batch(rows)
                    rows, bytes_held = [], 0
        for left in windows.windows.values():
            emit(left, True)
        if rows:
            yield _batch(rows)

    pieces = materialize(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text")).mapInArrow(first, PIECES), "pack")
    closed, left = pieces.filter("not open"), pieces.filter("open")

    def merge(t: pa.Table) -> pa.Table:
        """Pack whole leftover windows into fewer; those that stay open keep so."""
        found: dict[int, list[tuple]] = {}
        for r in t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).select(_SCHEMA.names).to_pylist():
            found.setdefault(r["sequence_id"], []).append(tuple(r[n] for n in _SCHEMA.names))
        windows, rows = OpenWindows(open_windows, window), []

        def emit(group: list[list[tuple]], is_open: bool) -> None:
            offset, seq = 0, group[0][0][5]
            for p in (p for one in group for p in one):
                rows.append((*p[:5], seq, offset, is_open))
                offset += p[2]

        for one in sorted(found.values(), key=lambda w: -sum(p[2] for p in w)):
            for full in windows.place(one, sum(p[2] for p in one)) or ():
                emit(full, False)
        for group in windows.windows.values():
            emit(group, True)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    groups = left.select(F.max(F.shiftright("sequence_id", 40))).first()[0]
    groups = 0 if groups is None else groups + 1
    done, level = [closed], 1
    while groups > 1:
        level *= fan_in
        merged = left.withColumn("g", F.shiftright("sequence_id", 40) / F.lit(level)).withColumn("g", F.floor("g"))
        merged = materialize(merged.groupBy("g").applyInArrow(merge, PIECES), "pack-left")
        done.append(merged.filter("not open"))
        left, groups = merged.filter("open"), -(-groups // fan_in)
    done.append(left)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("open")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
