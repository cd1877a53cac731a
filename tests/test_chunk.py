import random

from pyspark.sql import functions as F

from lodestone.operators import chunk
from tests.support import value


def sections(text):
    return list(chunk.sections(text))


def test_trails_go_by_depth():
    note = "intro\n# A\none\n### C\nskips a level\n### D\nstays under C\n## B\nunder A"
    assert [(h, t) for h, t, _, _ in sections(note)] == [("", "intro"), ("A", "one"), ("A > C", "skips a level"), ("A > C > D", "stays under C"), ("A > B", "under A")]


def test_lines_fences_and_deep_headings():
    note = "```\n# fenced\n```\n#### four\n# Empty\n# Last\nx"
    assert sections(note) == [("", "```", 0, 0), ("fenced", "```\n#### four", 1, 3), ("Last", "x", 5, 6)]


def test_a_short_note_is_one_passage_with_its_headings():
    assert chunk.chunk_text("# A\nx") == [("", "# A\nx", 0, 1)]
    assert chunk.chunk_text("") == []
    assert len(chunk.chunk_text("a" * 1600)) == 1 and chunk.chunk_text("a" * 1600)[0][0] == ""
    assert chunk.chunk_text("# H\n" + "a" * 1601)[0][:1] == ("H",)


def test_long_sections_are_packed_by_paragraph():
    parts = ["p" * 1000, "q" * 1000, "r" * 1000, "s" * 3000]
    found = chunk.chunk_text("\n\n".join(parts))
    assert [t for _, t, _, _ in found] == ["\n\n".join(parts[:2]), parts[2], parts[3]]
    assert [(a, b) for _, _, a, b in found] == [(0, 2), (3, 3), (4, 6)]


def test_chunks_hold_all_text():
    random.seed(3)
    for _ in range(20):
        words = [random.choice(["word", "\n\n", "\n# head\n", "text. "]) for _ in range(900)]
        body = " ".join(words).strip()
        kept = "".join(t for _, t, _, _ in chunk.chunk_text(body))
        assert kept.count("word") == body.count("word")


def test_passages_are_numbered(spark):
    notes = spark.createDataFrame([("a.md", 1, "---\nx: y\n---\n# H\ntext"), ("b.md", 1, ""), ("c.md", 1, None)], "file string, mtime long, content string")
    found = chunk.passages(notes).collect()
    assert [(r.file, r.chunk_no, r.text) for r in found] == [("a.md", 0, "# H\ntext")]


def test_same_chunks(spark):
    one = chunk.chunks(F.lit("# A\nx"))
    assert value(spark, chunk.same_chunks(one, chunk.chunks(F.lit("# A\nx "))), x="") is True
    assert value(spark, chunk.same_chunks(one, chunk.chunks(F.lit("# A\ny"))), x="") is False
