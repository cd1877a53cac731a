import pytest
from pyspark.sql import functions as F

from lodestone.operators import embed, highlight, phrases

# A passage, and phrases that it must and must not give.
PASSAGE = (
    0,
    "Topics/Agency and Parenting.md",
    "Divine Sovereignty and Mans Will",
    "A parent's role is to teach the child. Raising children requires discipline and desire. Agency is opposed to determinism. That is an idea.",
)


def test_candidates_of_a_passage(spark):
    rows = spark.createDataFrame([PASSAGE], "passage_id long, file string, heading string, text string")
    found = {r.phrase.lower() for r in phrases.candidates(rows).collect()}
    assert {"divine sovereignty", "agency", "determinism", "desire", "teach the child", "raising children"} <= found
    assert not {"idea", "thought", "the", "is"} & found


def test_candidates_are_few_and_distinct(spark):
    rows = spark.createDataFrame([(0, "a.md", "", "word " * 500 + "end.")], "passage_id long, file string, heading string, text string")
    found = phrases.candidates(rows).collect()
    keys = [(r.field, r.phrase.lower()) for r in found]
    assert len(keys) == len(set(keys)) <= 40
    assert sorted(r.pos for r in found) == list(range(len(found)))


def test_batches_and_counts():
    sizes = []

    class Zero:
        dimension = 4

        def embed(self, texts):
            import numpy as np

            sizes.append(len(texts))
            return np.zeros((len(texts), 4), "float32")

    found = embed.embed_all(Zero(), [f"passage {i}" for i in range(19)], "query")
    assert sizes == [8, 8, 3] and len(found) == 19

    class Short(Zero):
        def embed(self, texts):
            return super().embed(texts)[1:]

    with pytest.raises(ValueError, match="returned"):
        embed.embed_all(Short(), ["a", "b"])


def test_each_phrase_is_embedded_once(spark):
    rows = spark.createDataFrame([(0, 0, "Free Will"), (1, 0, "free will "), (1, 1, "agency")], "passage_id long, pos int, phrase string")
    known = spark.createDataFrame([("agency", [1])], "phrase_key string, vector array<smallint>")
    found = embed.embed_phrases(rows, known).collect()
    assert sorted(r.phrase_key for r in found) == ["agency", "free will"]
    assert next(r.vector for r in found if r.phrase_key == "agency") == [1]


CANDIDATE = "passage_id long, pos int, phrase string, field string, sentence_id int, start int, `end` int, words int, has_noun boolean, has_expression boolean, adjective_only boolean, quality double, vector array<smallint>"


def _choose(spark, rows, query="free will", **options):
    frame = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], CANDIDATE)
    scored = highlight.score_candidates(frame, F.lit(query), F.array(F.lit(1.0)))
    return {r.field: [(h.phrase, round(h.score, 2)) for h in r.highlights] for r in highlight.select_highlights(scored, ["passage_id"], **options).collect()}


def _row(phrase, score, start, end, field="body", sentence=0, adjective=False, quality=0.04):
    return (phrase, field, sentence, start, end, end - start + 1, True, False, adjective, quality, [round(score * 32767)])


def test_both_phrases_of_the_example_are_chosen(spark):
    found = _choose(spark, [_row("agency", 0.68, 0, 0), _row("free will", 0.84, 2, 3, quality=0.09)], single_min=0.62, phrase_min=0.56, max_phrases=5)
    assert found == {"body": [("free will", 0.89), ("agency", 0.68)]}


def test_overlaps_thresholds_and_limits(spark):
    rows = [_row("free will", 0.8, 0, 1), _row("will power", 0.7, 1, 2), _row("power", 0.5, 3, 3), _row("red", 0.65, 4, 4, adjective=True), _row("name one", 0.9, 0, 1, "filename"), _row("name two", 0.9, 2, 3, "filename"), _row("name three", 0.9, 4, 5, "filename")]
    found = _choose(spark, rows, query="nothing")
    assert found["body"] == [("free will", 0.8)]
    assert len(found["filename"]) == 2
