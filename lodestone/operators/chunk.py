"""Notes to passages: sections by heading, long sections by paragraph.

Sections depend on all lines before them, so the parser is one Arrow UDF over the
notes; all else is expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: A note of up to so many characters is one passage; a section of up to
#: so many is not split.
SINGLE, LARGEST = 1600, 2400
CHUNKS = "array<struct<heading: string, text: string, line_start: int, line_end: int>>"

_HEADING = re.compile(r"(#{1,3})\s+(.+)")
_BREAK = re.compile(r"\n\n+")
_BLANK = " \t\n\r\f\v                 　﻿"


def sections(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(heading trail, body, first line, last line) of each section that has a body.

    A trail keeps one heading per depth that has been opened: a heading of level n
    closes what stands at depth n or deeper, so a level may be skipped. Headings in
    code fences count; four marks and more are body text.
    """
    trail: list[str] = []
    body: list[str] = []
    begin = 0
    lines = text.split("\n")
    for at, line in enumerate([*lines, None]):
        heading = _HEADING.match(line) if line is not None else None
        if line is not None and not heading:
            body.append(line)
            continue
        if whole := "\n".join(body).strip(_BLANK):
            yield " > ".join(trail), whole, begin, at - 1
        if heading:
            del trail[len(heading[1]) - 1 :]
            trail.append(heading[2].strip(_BLANK))
            body, begin = [], at


def _packed(heading: str, text: str, begin: int, end: int, largest: int) -> Iterator[tuple[str, str, int, int]]:
    """A long section as runs of whole paragraphs; a paragraph alone may be longer.

    Where runs begin is found from the paragraphs' lengths; then each is cut out, with
    the lines that it takes. Between paragraphs one empty line counts.
    """
    paragraphs = _BREAK.split(text)
    starts, room = [0], largest
    for i, size in enumerate(map(len, paragraphs)):
        if i > starts[-1] and size > room:
            starts.append(i)
            room = largest
        room -= size + 2
    first = begin
    for a, b in pairwise([*starts, len(paragraphs)]):
        last = first + sum(p.count("\n") for p in paragraphs[a:b]) + 2 * (b - a - 1)
        yield heading, "\n\n".join(paragraphs[a:b]).strip(_BLANK), first, end if b == len(paragraphs) else last
        first = last + 1


def chunk_text(clean: str, single: int = SINGLE, largest: int = LARGEST) -> list[tuple[str, str, int, int]]:
    """The passages of a note without front matter, trimmed."""
    if not clean:
        return []
    if len(clean) <= single:
        return [("", clean, 0, clean.count("\n"))]
    out: list[tuple[str, str, int, int]] = []
    for s in sections(clean):
        out += [s] if len(s[1]) <= largest else _packed(*s, largest)
    return [c for c in out if c[1].strip(_BLANK)]


_CHUNK_TYPE = pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())]))
_SECTION_NAMES = ("heading", "text", "line_start", "line_end")


def _chunk(clean: pa.Array) -> pa.Array:
    return pa.array([[dict(zip(_SECTION_NAMES, c, strict=True)) for c in chunk_text(t or "")] for t in clean.to_pylist()], _CHUNK_TYPE)


_CAREFUL = pa.struct([("chunks", _CHUNK_TYPE), ("error", pa.string())])


def _chunk_carefully(clean: pa.Array) -> pa.Array:
    """Each text's passages, or what went wrong with that text."""
    out = []
    for t in clean.to_pylist():
        try:
            out.append({"chunks": [dict(zip(_SECTION_NAMES, c, strict=True)) for c in chunk_text(t or "")], "error": None})
        except Exception as e:  # any failure is that note's own
            out.append({"chunks": [dict.fromkeys(_SECTION_NAMES)], "error": f"{type(e).__name__}: {e}"})
    return pa.array(out, _CAREFUL)


def _sections(clean: pa.Array) -> pa.Array:
    return pa.array([[dict(zip(_SECTION_NAMES, c, strict=True)) for c in sections(t or "")] for t in clean.to_pylist()], _CHUNK_TYPE)


def cleaned(content: Column) -> Column:
    return T.trim(T.strip_frontmatter(T.text_or_empty(content)))


def chunks(content: Column) -> Column:
    return F.arrow_udf(_chunk, CHUNKS)(cleaned(content))


def parse_sections(content: Column) -> Column:
    return F.arrow_udf(_sections, CHUNKS)(T.text_or_empty(content))


def passages(notes: DataFrame) -> DataFrame:
    """One row per passage of ``notes`` (file, mtime, content), numbered in its note, with
    ``chunk_error``: null, or why the note could not be cut; such a note has one row,
    without a number."""
    cut = F.arrow_udf(_chunk_carefully, f"chunks {CHUNKS}, error string")(cleaned(F.col("content")))
    made = notes.select("file", "mtime", T.fingerprint(F.col("content")).alias("content_hash"), cut.alias("_made"))
    spread = made.select("file", "mtime", "content_hash", F.col("_made.error").alias("chunk_error"), F.posexplode("_made.chunks").alias("chunk_no", "c"))
    number = F.when(F.col("chunk_error").isNull(), F.col("chunk_no"))
    return spread.select("file", number.alias("chunk_no"), "c.heading", "c.text", "c.line_start", "c.line_end", "mtime", "content_hash", "chunk_error")


def same_chunks(a: Column, b: Column) -> Column:
    """Whether two arrays of passages are equal in number, text, heading and lines."""
    return (F.size(a) == F.size(b)) & (a == b)
