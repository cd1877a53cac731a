import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, media, results, search
from lodestone.plans import session, settings

PASSAGES = [(0, "Agency/Note a.md", [1.0, 0.0]), (1, "Other/Note b.md", [0.9, 0.1]), (2, "Agency/Note a.md", [0.2, 0.9]), (3, "Other/Note c.md", [0.9, 0.1]), (4, "Other/zero.md", [0.0, 1.0])]


@pytest.fixture(scope="module")
def passages(spark):
    return spark.createDataFrame(PASSAGES, "passage_id long, file string, embedding array<float>")


def _ids(frame):
    return [r.passage_id for r in frame.collect()]


def test_order_ties_and_threshold(passages):
    assert _ids(search.search(passages, [1.0, 0.0], "", min_score=0.5)) == [0, 1, 3]
    assert _ids(search.search(passages, [1.0, 0.0], "", min_score=0.5, top_k=2)) == [0, 1]
    assert _ids(search.search(passages, [1.0, 0.0], "", min_score=0.0, file="Agency/Note a.md")) == [0, 2]


def test_the_window_hangs_on_the_best_ranked_hit(passages):
    """With a large folder boost passage 2 ranks first; its similarity sets the floor."""
    found = search.search(passages, [1.0, 0.0], "agency", min_score=0.0, score_window=0.05, folder_path_boost=2.0).collect()
    assert [r.passage_id for r in found] == [0, 1, 3] or found[0].passage_id == 0
    low = search.search(passages.filter("passage_id > 0"), [1.0, 0.0], "agency", min_score=0.0, score_window=0.05, folder_path_boost=2.0).collect()
    assert [r.passage_id for r in low] == [2, 1, 3]
    assert low[0].score == 1.0 and low[0].semantic_score < 0.3


def test_notes_keep_a_best_score_of_zero(spark, passages):
    found = {r.file: r.score for r in search.scores_per_note(passages, F.array(F.lit(1.0), F.lit(0.0))).collect()}
    assert found["Other/zero.md"] == 0.0 and found["Agency/Note a.md"] == 1.0


def test_block_top_k_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).astype("float32")
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "passage_id long, embedding array<float>").repartition(5)
    found = search.block_top_k(rows, rows.withColumnRenamed("passage_id", "query_id"), 3, block=7, exclude_same=True).collect()
    got = {(r.query_id, r["rank"]): r.passage_id for r in found}
    d = np.round(v.astype(float) @ v.astype(float).T, 12)
    np.fill_diagonal(d, -np.inf)
    for i in range(60):
        assert [got[i, k] for k in (1, 2, 3)] == sorted(range(60), key=lambda j: (-d[i, j], j))[:3]


def test_results_by_note_and_pool(spark):
    rows = [(0, "a.md", "H", "Alpha agency. Beta.", 0.9, 0.8, 0.9), (1, "a.md", "H", "Alpha agency. Beta.", 0.8, 0.8, 0.8), (2, "b.md", "H", "```x```", 0.7, 0.7, 0.7), (3, "a.md", "H", "Other agency text.", 0.6, 0.6, 0.6)]
    hits = spark.createDataFrame(rows, "passage_id long, file string, heading string, text string, score double, semantic_score double, ranking_score double")
    item = lambda p: F.array(F.struct(F.lit(p).alias("phrase"), F.lit(0.5).alias("score")))
    hits = hits.withColumns({"filename_boost": F.lit(0.0), "folder_path_boost": F.lit(0.0), "line_start": F.lit(0), "line_end": F.lit(1), "filename_highlights": item("Name"), "heading_highlights": item("name"), "semantic_highlights": item("[[x|agency]]")})
    cards = results.group_by_note(hits, "agency", 10).collect()
    assert [c.file for c in cards] == ["a.md"]
    assert [s.text for s in cards[0].snippets] == ["Alpha agency. Beta.", "Other agency text."]
    assert cards[0].semantic_score == 0.9 and cards[0].filename_highlights == ["Name"]
    assert [r.phrase for r in results.phrase_pool(hits).collect()] == ["Name", "agency"]
    assert [r.passage_id for r in results.by_passage(hits, "agency", 10).collect()] == [0, 1, 3]


def test_graph_merge_cut_and_layout(spark):
    nodes = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.9, 0.1]), ("c", 2, [0.0, 1.0])], "file string, node long, embedding array<double>")
    edges = graph.knn_edges(nodes, 1)
    assert {(r.source, r.target) for r in edges.collect()} == {("a", "b"), ("b", "a"), ("c", "b")}
    assert [(r.source, r.target) for r in graph.capped(edges, 1).collect()] == [("a", "b")]
    links = spark.createDataFrame([("b", "a", 1), ("c", "x", 2), ("c", "b", 0), ("x", "x", 1)], "source string, target string, count int")
    merged = graph.merge_links(edges, links)
    assert {(r.source, r.target, r.hard) for r in merged.collect()} == {("b", "a", True), ("c", "x", True), ("x", "x", True), ("c", "b", False)}
    assert {r.id: r.degree for r in graph.degrees(merged).collect()} == {"a": 1, "b": 2, "c": 2, "x": 2}
    placed = graph.layout(graph.endpoints(merged)).collect()
    assert len(placed) == 4 and all(0 <= r.x <= 1 and 0 <= r.y <= 1 for r in placed)
    zero = graph.centroids(spark.createDataFrame([(0, "z", [1.0]), (1, "z", [-1.0])], "passage_id long, file string, embedding array<float>")).first()
    assert zero.embedding == [0.0]


def test_images_and_matches():
    note = '![[a.png|x]] ![alt](<b c.jpg> "t") <img alt="z" src="d.gif"> ```![no](n.png)``` word ![[a.png]]'
    assert media.image_references(note, []) == [("a.png", "a.png"), ("b c.jpg", "alt"), ("d.gif", "z")]
    assert media.image_references(note, ["word"])[0] == ("d.gif", "z")
    found = media.phrase_matches("Free will and free willing, will", ["will", "free will", "ab", "a b c d"])
    assert found == [(0, 9, "Free will"), (28, 32, "will")]


def test_settings_and_sessions(spark):
    stored = {"top_k": 5, "graph_k": 7, "model_tweaks": {"mobile": {"top_k": 6, "min_score": 0.4}, "bge": {"top_k": 8}}}
    found = settings.load_settings(stored)
    assert (found.tuning.top_k, found.tuning.min_score, found.graph_k, found.graph_max_edges) == (8, 0.4, 7, 2000)
    fifo, lru = session.BoundedCache(2, False), session.BoundedCache(2, True)
    for cache in (fifo, lru):
        for key in "abac":
            cache.get(key, lambda key=key: key)
    assert list(fifo.entries) == ["b", "c"] and list(lru.entries) == ["a", "c"]
    live = session.LiveSearch(spark, lambda r: live.__setattr__("newest", live.newest + r) or "found")
    assert live.search(0) == "found"
    with pytest.raises(session.Superseded):
        live.search(1)
    assert session.page_limits(0, 10, False) == (10, 40) and session.page_limits(500, 10, True) == (500, 510)
    assert session.step(0, -1, 3) == 2 and session.step(0, 1, 0) == 0
    assert not session.searchable(" a ")


def test_a_newer_search_cancels_the_one_that_runs(spark):
    import threading
    import time

    @F.udf("long")
    def slowly(x):
        time.sleep(8)
        return x

    def run(request):
        return spark.range(4, numPartitions=4).select(slowly("id")).collect() if request == "slow" else request

    live, seen = session.LiveSearch(spark, run, gap=0.01), []

    def first():
        try:
            seen.append(live.search("slow", immediate=True))
        except session.Superseded:
            seen.append("superseded")

    thread = threading.Thread(target=first)
    thread.start()
    while not live.running:
        time.sleep(0.05)
    time.sleep(1.5)
    began = time.monotonic()
    assert live.search("quick") == "quick" and time.monotonic() - began < 6
    thread.join()
    assert seen == ["superseded"]


def test_matches_equal_a_plain_regex():
    import random
    import re

    def plain(text, phrases):
        taken = []
        for p in sorted({p.lower(): p for p in reversed(phrases)}.values(), key=len, reverse=True):
            for m in re.finditer(rf"(?<![^\W_]){re.escape(p)}(?![^\W_])", text, re.I):
                if all(m.end() <= a or m.start() >= b for a, b, _ in taken):
                    taken.append((m.start(), m.end(), m[0]))
        return sorted(taken)

    random.seed(1)
    for _ in range(500):
        text = "".join(random.choices(["aba", "ABA ", " ", "_", "é", "1", "aba aba", "ſ", ".", "É "], k=random.randrange(30)))
        phrases = random.choices(["aba", "aba aba", "é aba", "aba aba aba", "ab a"], k=3)
        assert media.phrase_matches(text, phrases) == plain(text, phrases)
