"""Language ID, toxicity, the chain itself, and the pipeline."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import crf, langid, tagging, toxicity
from tests.llm.test_joins import _components
from tests.llm.test_native import _brute
from tests.support import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _forward_backward(scores, transitions):
    e, tie, k = np.exp(scores), np.exp(transitions), scores.shape[1]
    forward, backward = [np.ones(k)], [np.ones(k)]
    for i, x in enumerate(e):
        forward.append((forward[-1] @ tie if i else forward[-1]) * x)
        forward[-1] /= forward[-1].sum()
    for x in e[::-1]:
        backward.append(tie @ (x * backward[-1]))
        backward[-1] /= backward[-1].sum()
    p = np.array(forward[1:]) * np.array(backward[:-1][::-1])
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("lengths", [[5, 1, 0, 130, 64, 65], [700], [0, 0], [1]])
def test_blocks_don_t_change_the_marginals(lengths):
    rng = np.random.default_rng(0)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    scores, transitions = rng.normal(size=(offsets[-1], 3)) * 3, rng.normal(size=(3, 3))
    found = crf.marginals(scores, offsets, transitions)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b > a:
            assert np.allclose(found[a:b], _forward_backward(scores[a:b], transitions))


def test_the_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(5)
    types = pa.array(["ab", "abc", "xy", "zzz"], pa.large_string())
    rows = [rng.integers(0, 4, n) for n in (3, 1, 6)]
    tags = [rng.integers(0, 3, len(r)) for r in rows]
    goal = crf.Likelihood(3, types, rows, tags, {0: np.array([1]), 1: np.array([2, 3])}, 0.01)
    params = [rng.normal(size=p.shape) * 0.3 for p in goal.start]

    def value(params):
        scores, total = goal.scores(params), 0.0
        for a, b, own in zip(goal.offsets[:-1], goal.offsets[1:], tags, strict=True):
            paths = []
            for path in itertools.product(range(3), repeat=b - a):
                paths.append(sum(scores[a + i, y] for i, y in enumerate(path)) + sum(params[1][x, y] for x, y in itertools.pairwise(path)))
                if path == tuple(own):
                    total += paths[-1]
            total -= np.log(np.exp(paths).sum())
        return total / len(scores) - 0.005 * sum((p * p).sum() for p in params)

    for x, g in zip(params, goal.gradient(params), strict=True):
        for place in [tuple(p) for p in np.argwhere(np.ones_like(x))[:40]]:
            up, down = ([p.copy() for p in params] for _ in range(2))
            i = next(i for i, p in enumerate(params) if p is x)
            up[i][place] += 1e-5
            down[i][place] -= 1e-5
            assert np.isclose((value(up) - value(down)) / 2e-5, g[place], atol=1e-7)


@pytest.mark.parametrize("length", [5, 64, 65, 200])
def test_pairs_of_labels_are_exact_across_blocks(length):
    rng = np.random.default_rng(2)
    scores, transitions = rng.normal(size=(length, 2)), rng.normal(size=(2, 2))
    _, found = crf.forward_backward(scores, np.array([0, length]), transitions, count_pairs=True)
    e, tie = np.exp(scores), np.exp(transitions)
    forward, backward = [e[0] / e[0].sum()], [np.ones(2)]
    for x in e[1:]:
        now = forward[-1] @ tie * x
        forward.append(now / now.sum())
    for x in e[:0:-1]:
        now = tie @ (x * backward[-1])
        backward.append(now / now.sum())
    backward.reverse()
    wanted = np.zeros((2, 2))
    for t in range(1, length):
        pair = forward[t - 1][:, None] * tie * (e[t] * backward[t])
        wanted += pair / pair.sum()
    assert np.allclose(found, wanted) and np.isclose(found.sum(), length - 1)


def test_neighbours_change_a_word_s_tag():
    types = pa.array(["mild", "vile", "calm"], pa.large_string())
    rows = [np.array([1, 0, 0]), np.array([2, 0, 0])] * 20
    model = crf.fit(["clean", "toxic"], types, rows, [np.array([1, 1, 1]), np.array([0, 0, 0])] * 20, {}, rounds=60)
    p, *_ = tagging.tag(pa.array(["vile mild", "calm mild"]), model)
    assert p[1, 1] > 0.7 > 0.3 > p[3, 1]


def test_the_sample_is_bounded_whatever_repeats(spark):
    rows = [(i, f"text {i}", f"l{i % 50}") for i in range(1000)] + [(7, "same", "hot")] * 900 + [(7, f"own {i}", "hot") for i in range(900)] + [(1, "a", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    sample, counts = tagging.bounded(docs, "lang", 30, 3, "text")
    by = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    assert len(counts) == 3 and set(by) <= set(counts) and "hot" in counts and max(by.values()) <= 30


def test_all_of_the_sample_is_learned_from(spark, monkeypatch):
    """Neither the order of the sample nor a budget decides which rows are fitted."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda labels, types, rows, tags, lexicons, **_: seen.append(rows) or crf.Model(labels, np.zeros((crf.BUCKETS, 2), np.float32), np.zeros((2, 2)), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((1, 2))))
    docs, labels = _toxic_corpus(spark)
    toxicity.train(docs, labels)
    toxicity.train(docs.orderBy(F.desc("text")), labels)
    assert [len(r) for r in seen] == [400, 400] and sum(map(len, seen[0])) == sum(map(len, seen[1])) == 400 * 120


def test_words_and_their_places():
    texts = pa.array(["Ab, cé 9x!", None, "", "日本 b"])
    model = crf.Model(["x", "y"], np.zeros((crf.BUCKETS, 2), np.float32), np.zeros((2, 2)), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((1, 2)))
    p, offsets, start, length = tagging.tag(texts, model)
    assert offsets.tolist() == [0, 3, 3, 3, 5] and p.shape == (5, 2)
    assert list(zip(start.tolist(), length.tolist(), strict=True)) == [(0, 2), (4, 2), (8, 1), (0, 2), (3, 1)]


def test_a_chain_learns_to_switch():
    words = [f"{p}{i}" for p in ("ab", "xy") for i in range(10)]
    rng = np.random.default_rng(1)
    rows = [np.concatenate([rng.integers(0, 10, 8), rng.integers(10, 20, 8)]) for _ in range(60)]
    tags = [np.repeat([0, 1], 8)] * 60
    model = crf.fit(["a", "x"], pa.array([f"{w}q" for w in words], pa.large_string()), rows, tags, {0: np.arange(10)}, rounds=30)
    found = langid.predict(pa.array(["ab1q ab2q xyzq xy4q xy5q"]), model).to_pylist()[0]
    assert [s["lang"] for s in found["spans"]] == ["a", "x"] and model.transitions[0, 0] > model.transitions[1, 0]


def _split(spark):
    return spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")


def test_languages_of_held_out_documents(spark):
    found = langid.op4_language_id(spark, SMALL.replace("0.001", "0.01")).join(_split(spark), "doc_id").filter("held_out").toPandas()
    assert len(found) > 100 and (found.lang == found.lang_pred).mean() >= 0.98
    assert found.score.between(0, 1).all()


def test_language_edge_cases(spark):
    rows = [(i, "der die das und " * 5, "de", "s", 1) for i in range(20)] + [(100 + i, "the and of that " * 5, "en", "s", 1) for i in range(20)]
    odd = [(1000, None, "de", "s", 1), (1001, "", "en", "s", 1), (1002, "123 !? ¿", None, None, None), (None, "the and", "en", "s", 1), (1003, "und die " * 20000, None, "s", 1), (1004, "ß", "de", "s", 1)]
    docs = spark.createDataFrame(rows + odd, DOCS).withColumn("lang_pred", F.lit("clash"))
    found = {r.doc_id: r["_lang"] for r in langid.identify(docs, langid.train(docs)).collect()}
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and found[1000].score == 0
    assert found[None].lang_pred == "en" and found[1003].lang_pred == "de" and found[1003].score > 0.9
    assert found[1003].spans[0].start == 0 and found[1003].spans[-1].start + found[1003].spans[-1].length == 8 * 20000 - 1
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.train(nothing) is None and {r["_lang"].lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    one = docs.filter("lang = 'de'")
    assert {r["_lang"].lang_pred for r in langid.identify(rows_of(spark, [(1, "xyz")]), langid.train(one)).collect()} == {"de"}
    assert langid.identify(docs.limit(0), langid.train(docs)).count() == 0


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _toxic_corpus(spark):
    random.seed(3)
    clean = ["".join(random.choices("abcdefghij", k=7)) for _ in range(300)]
    docs, labels = [], []
    for i in range(400):
        words = random.choices(clean, k=120)
        if i % 5 == 0:
            for _ in range(6):
                words[random.randrange(120)] = random.choice(["vileone", "vileness", "badthing", "rotten"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1 if i % 5 == 0 else 0))
    return rows_of(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_copies_teach_once():
    text = [f"{a}{b}" for a in "abcde" for b in "fghij"]
    rows = [("1", text), ("1", [*text[:-1], "zz"]), ("0", text[::-1]), ("0", ["x"]), ("0", ["x"])]
    assert toxicity.without_copies(rows) == [rows[0], rows[2], rows[3]]


def test_toxic_documents_and_spans(spark):
    docs, labels = _toxic_corpus(spark)
    model = toxicity.train(docs, labels.filter("doc_id < 300"))
    found = toxicity.score_documents(docs.filter("doc_id >= 300"), model).collect()
    assert all((r["_toxicity"].score >= 0.5) == (r.doc_id % 5 == 0) for r in found)
    for r in found:
        for s in r["_toxicity"].spans:
            assert r.doc_id % 5 == 0 and set(r.text[s.start : s.start + s.length].split()) <= {"vileone", "vileness", "badthing", "rotten"} and s.probability >= 0.5


def test_toxicity_edge_cases(spark):
    docs, labels = _toxic_corpus(spark)
    model = toxicity.train(docs, labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (9999, 1), (0, 1)], "doc_id long, toxic int")))
    odd = rows_of(spark, [(1, None), (2, ""), (3, "123"), (None, "rotten rotten badthing vileone"), (4, "abcdefg " * 30000 + "rotten"), (5, "x"), (5, "x")]).withColumn("score", F.lit("clash"))
    found = toxicity.score_documents(odd, model).collect()
    score = {r.doc_id: r["_toxicity"].score for r in found}
    assert len(found) == 7 and score[1] == score[2] == score[3] < 0.5 < score[None] and score[3] < score[4] < score[None]
    assert toxicity.train(docs, labels.filter("toxic = 1")) == 1.0 and toxicity.train(docs, labels.limit(0)) == 0.0
    assert {r["_toxicity"].score for r in toxicity.score_documents(odd, 0.0).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_scores_of_held_out_documents(spark):
    sf_dir = SMALL.replace("0.001", "0.01")
    found = toxicity.op8_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (found.toxic == found.predicted).mean() >= 0.9
    assert found[found.toxic == 1].score.mean() > found[found.toxic == 0].score.mean() + 0.3


CLASH = ("_rid", "_rid_", "_lang_id", "_toxic", "rid", "keep", "n_hit", "item")


def _with_clashes(docs):
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASH})


def test_stages_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    half = " ".join(["the and of that with"] * 10 + ["der und die nicht das"] * 10 + ["pour les des dans que"] * 10)
    extra = spark.createDataFrame([(90001, None, None, None, None), (90002, "12 !", "en", "s", 4), (90003, docs.first().text, "fr", "s", 1), (90004, half, "en", "s", 1)], DOCS)
    docs = _with_clashes(docs.unionByName(extra)).repartition(5)  # a shuffle: rows have no lasting order
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, SMALL)
        if name != "packing":
            assert docs.columns == columns
            found = docs.collect()
            kept[name] = {r.doc_id for r in found}
            assert all(r[c] == f"{c}{r.doc_id}" for r in found for c in CLASH)
            docs = docs.repartition(7)
    assert not kept["language_id"] & {90001, 90002, 90004} and 90003 in kept["language_id"]
    assert len(kept["language_id"]) >= 195 and 90003 not in kept["ngram_join"]
    assert kept["language_id"] >= kept["toxicity"] >= kept["ngram_join"] >= kept["decontaminate"]
    assert {r.doc_id for r in docs.select("doc_id").collect()} == kept["decontaminate"]


def test_the_whole_pipeline(spark):
    """Against its parts, each by its own query's figures or by brute force."""
    found = corpus_pipeline.run(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, SMALL), "t")
        if name == "ngram_join":
            own = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            assert sorted(r.doc_id for r in docs.collect()) == sorted({c if n else d for d, n, c in _components(own)})
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
            own = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            clean = {d for d, n, hit, _ in _brute(own, items) if not (hit > 0 and 20 * hit >= n)}
            assert {r.doc_id for r in docs.collect()} == clean
    assert set(found.doc_id) == {r.doc_id for r in docs.collect()}
    sizes = found.groupby("sequence_id").length.sum()
    assert sizes.max() <= 1024 and (found.groupby("doc_id").length.sum() == found.groupby("doc_id").doc_tokens.first()).all()


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SMALL)
        assert found.count() == 0
        docs = docs if name == "packing" else found
