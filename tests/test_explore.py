import pytest

from lodestone.operators import embed, index
from lodestone.plans import explore, settings
from lodestone.sources import index_store

NOTES = [
    ("Topics/Agency.md", 1, "Agency is the power to decide. Free will decides."),
    ("Topics/Parenting.md", 1, "Raising children requires discipline. Parents teach the child."),
    ("Other/Cooking.md", 1, "Boil the water and add salt. Stir the soup."),
]


@pytest.fixture(scope="module")
def explorer(spark):
    built = index.build_passages(spark.createDataFrame(NOTES, "file string, mtime long, content string")).cache()
    return explore.Explorer(built, embed.HashingEmbedder(), settings.load_settings({"min_score": 0.05, "highlight_result_min_score": 0.0}))


def test_cards_and_paging(explorer):
    cards, more = explorer.cards("free will and agency")
    found = cards.collect()
    assert found[0].file == "Topics/Agency.md" and not more
    assert "Free will decides." in found[0].snippets[0].text
    assert explorer.cards("a") == (None, False)
    assert len(explorer.vectors.entries) == 1


def test_one_note(explorer):
    rows = explorer.passages_of("teach the child", "Topics/Parenting.md").collect()
    assert [r.file for r in rows] == ["Topics/Parenting.md"]
    matches = explorer.find_in_note("teach the child", "Topics/Parenting.md", NOTES[1][2])
    assert ("teach the child" in {m.text for m in matches}) and all(a.to <= b["from"] for a, b in zip(matches, matches[1:], strict=False))


def test_a_note_s_own_text_is_read_once(spark):
    notes = spark.createDataFrame(NOTES, "file string, mtime long, content string")
    own = explore.Explorer(index.build_passages(notes), embed.HashingEmbedder(), settings.load_settings({"min_score": 0.05}), notes=notes)
    assert own.is_alive()
    matches = own.find_in_note("the water", "Other/Cooking.md")
    assert [(m["from"], m.text, m.line, m.ch) for m in matches][:1] == [(5, "the water", 0, 5)]
    assert own.note_text("none.md") == "" and list(own.texts.entries) == ["Other/Cooking.md", "none.md"]
    own.refresh(index.build_passages(notes.filter("file LIKE 'Topics%'")))
    assert not own.texts.entries and not own.found.entries
    assert {r.file for r in own.cards("boil the water and add salt")[0].collect()} <= {"Topics/Agency.md", "Topics/Parenting.md"}


def test_the_graph(explorer, spark):
    links = spark.createDataFrame([("Topics/Agency.md", "Topics/Parenting.md", 1)], "source string, target string, count int")
    nodes, edges = explorer.graph(links, "salt in the soup")
    best = max(nodes.collect(), key=lambda n: n.score)
    assert best.id == "Other/Cooking.md" and best.label == "Cooking"
    assert [(e.source, e.target) for e in edges.collect() if e.hard] == [("Topics/Agency.md", "Topics/Parenting.md")]


def test_an_empty_index_is_not_ready(spark):
    empty = explore.Explorer(spark.createDataFrame([], index_store.SCHEMA), embed.HashingEmbedder())
    with pytest.raises(explore.NotReady):
        empty.cards("any query")
    assert not empty.is_alive()
