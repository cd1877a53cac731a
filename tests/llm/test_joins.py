"""N-gram join, top-k, sharding, packing and scoring: edge cases and brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, components, lm_score, ngram_join, packing, sharding, topk

DOCS = "doc_id long, text string"


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", _lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def _components(docs):
    sets = [_shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(top(i), []).append(d)
    return sorted(((d, len(sets[i]), min((x for x in least[top(i)] if x is not None), default=None)) for i, (d, _) in enumerate(docs)), key=repr)


def _near_documents():
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [random.choices(vocabulary, k=random.choice([3, 5, 6, 30, 120])) for _ in range(12)]
    docs = []
    for i in range(240):
        words = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 4])):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        docs.append((i, " ".join(words).upper() if i % 7 == 0 else "\n".join(words)))
    passage = " ".join(random.choices(vocabulary, k=60))
    docs += [(1000 + i, passage + " " + " ".join(random.choices(vocabulary, k=40))) for i in range(30)]
    return docs + [(2000, None), (2001, ""), (2002, " \t"), (2003, "É é"), (2004, "é É"), (5, docs[6][1]), (5, docs[6][1]), (None, docs[9][1]), (2005, "one two"), (2006, "ONE TWO")]


@pytest.mark.parametrize("options", [{}, {"fragment_rows": 300, "rounds": 0}, {"fragment_rows": 1000, "rounds": 1}])
def test_components_equal_brute_force(spark, options):
    docs = _near_documents()
    frame = spark.createDataFrame(docs, DOCS).withColumns({"c": F.lit("clash"), "rid": F.lit(7)}).repartition(6)
    found = ngram_join.jaccard_components(frame, **options).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == _components(docs)
    kept = [r for r in found if r.keep]
    sizes = Counter((r.component_id, r.n_shingles == 0, r.doc_id if not r.n_shingles else None) for r in kept)
    assert set(sizes.values()) == {1} and all(r.doc_id == r.component_id for r in kept)


def test_all_pairs_on_request(spark):
    docs = _near_documents()
    found, members = ngram_join.similar_pairs(spark.createDataFrame(docs, DOCS).repartition(3))
    sets = {i: frozenset(_shingles(t)) for i, (_, t) in enumerate(docs)}
    distinct = sorted({s for s in sets.values() if s}, key=sorted)
    wanted = Counter(round(len(x & y) / len(x | y), 9) for i, x in enumerate(distinct) for y in distinct[:i] if 100 * len(x & y) >= 80 * len(x | y))
    assert Counter(round(r.jaccard, 9) for r in found.collect()) == wanted
    assert members.filter("n > 0").select("c").distinct().count() == len(distinct)


def test_candidates_are_dealt_to_no_more_than_they_need(spark):
    """Pieces of classes without a candidate stay where they are; rows dealt are pairs times fragments."""
    tokens = [(bytes([i]) * 16, list(range(-(2**63), 2**63, 2**57))[i::7]) for i in range(40)]
    survivors = spark.createDataFrame([(bytearray(c), t) for c, t in tokens], "c binary, tokens array<long>")
    pieces = ngram_join._pieces(survivors, ngram_join.COUNTED_FRAGMENTS)
    assert sorted(x for r in pieces.collect() for x in r.tokens) == sorted(x for _, t in tokens for x in t)
    assert pieces.count() <= 40 * ngram_join.COUNTED_FRAGMENTS
    sizes = {c: len(t) for c, t in tokens}
    pairs = [(bytearray(tokens[i][0]), bytearray(tokens[i + 7][0]), sizes[tokens[i][0]], sizes[tokens[i + 7][0]]) for i in range(5)]
    found = ngram_join._count_pairs(spark.createDataFrame(pairs, "a binary, b binary, na long, nb long"), pieces, 80).collect()
    wanted = {bytes(a): len(set(dict(tokens)[bytes(a)]) & set(dict(tokens)[bytes(b)])) for a, b, na, nb in pairs}
    assert {bytes(r.a): r.overlap for r in found} == {a: o for a, o in wanted.items() if 100 * o >= 80 * (2 * sizes[a] - o) or 100 * o >= 80 * (sizes[a] + sizes[a] - o)}


def test_no_documents_at_all(spark):
    none = spark.createDataFrame([], DOCS)
    assert ngram_join.jaccard_components(none).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert sharding.histogram_sort(none).count() == 0
    assert packing.pack(none).count() == 0
    assert lm_score.backoff_scores(none).count() == 0
    assert ngram_join.jaccard_components(spark.createDataFrame([(1, "a"), (2, None)], DOCS)).count() == 2


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "u long, v long")
    found = {r.u: r.v for r in components.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100}


@pytest.mark.parametrize("kind", ["long", "binary", "string", "int"])
def test_one_task_finds_the_components_that_the_steps_find(spark, monkeypatch, kind):
    random.seed(5)
    plain = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(7, 7), (3, 4), (4, 3)]
    name = {"binary": lambda i: bytearray(bytes([255 - i // 2, i % 251])), "string": lambda i: f"é{i}" if i % 3 else f"z{i}"}.get(kind, lambda i: i - 200)
    edges = spark.createDataFrame([(name(u), name(v)) for u, v in plain], f"u {kind}, v {kind}").repartition(5)
    found = []
    for most in (components.ONE_TASK_EDGES, 0):
        monkeypatch.setattr(components, "ONE_TASK_EDGES", most)
        found.append(sorted((r.u, r.v) for r in components.components(edges).collect()))
    assert found[0] == found[1] and len(found[0]) > 200


def test_components_of_documents_by_steps_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", 0)
    docs = _near_documents()
    found = ngram_join.jaccard_components(spark.createDataFrame(docs, DOCS).repartition(6)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == _components(docs)


def test_small_tables_take_few_jobs(spark):
    """Where tables are small, or a shuffle has many partitions, each job costs its start."""
    frame = spark.createDataFrame(_near_documents(), DOCS).repartition(6)
    spark.sparkContext.setJobGroup("few jobs", "a join of few documents")
    try:
        ngram_join.jaccard_components(frame).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs")) <= 70


def test_rounds_without_a_link_keep_their_lists(spark, monkeypatch):
    """Texts that share a passage, but no 80 %, and near copies of each: a round with hubs links
    nothing, so components and lists are what they were."""
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = random.choices(vocabulary, k=60)
    docs = [(i, " ".join(passage + random.choices(vocabulary, k=12 + i % 3))) for i in range(60)]
    docs += [(100 + i, " ".join(t.split()[:-1])) for i, t in docs]
    tags, write = [], ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, tag, *rest: tags.append(tag) or write(df, tag, *rest))
    found = ngram_join.jaccard_components(spark.createDataFrame(docs, DOCS).repartition(3), rounds=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == _components(docs)
    assert tags.count("hubs") == 2 and tags.count("others") == 1  # a round without a link, then the last
    assert tags.count("main") == 1 and tags.count("listed") == 1


def _top(rows, k):
    valid = [(i, [math.floor(64 * x) for x in v], n) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, n in valid:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w, m in valid if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"queries_in_block": 3, "stripe_rows": 100, "slice_rows": 64}])
def test_top_k_equals_brute_force(spark, options):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) / 3).tolist()) for i in range(330)]
    rows += [(i, rows[20][1]) for i in range(400, 440)]  # ties
    rows += [(20, [0.5] * 6), (20, [0.5] * 6), (500, None), (520, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (540, [float("nan")] * 6), (560, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (580, []), (600, [2.0, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(5)
    found = topk.top_k(common.materialize(frame, "t"), **options).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == _top(rows, 20)


def test_top_k_of_large_components_is_exact(spark):
    rows = [(i, [float(2**20 + i), float(-(2**19) * i), 1.0]) for i in range(45)] + [(i, [2.0**23 + i, 0.3 * i, -1.0]) for i in range(50, 70)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == _top(rows, 20)


def test_any_finite_component_has_a_score(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e307, -2.0]), (2, [-1.7e308, 0.0]), (3, [0.0, 3.0]), (20, [0.0, 1.0]), (21, [5e-324, -0.0])]
    found = {(r.query_id, r.vec_id): r.score for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found[0, 1] == 2**63 - 1 and found[0, 2] == -(2**63) and found[0, 3] == 64 * 192 and found[20, 3] == 64 * 192
    assert found[20, 1] == -128 * 64 and found[20, 21] == 0 and len(found) == 10


def test_reading_stops_when_outsiders_cannot_qualify():
    rng = np.random.default_rng(3)
    c = np.floor(64 * rng.normal(size=(4000, 12))).astype(np.int32)
    c[:30] += 300  # some that stand out
    q = np.floor(64 * np.abs(rng.normal(size=(5, 12))))
    found, scores, read = topk.contenders(q, topk.Lists(c), 21)
    wanted = c @ q.T
    for i in range(5):
        assert set(np.argsort(-wanted[:, i], kind="stable")[:21]) <= set(found[i]) and (scores[i] == wanted[found[i], i]).all()
        assert len(found[i]) <= 4000 // 16
    assert 0 < read < 2 * c.size  # from both ends: lists are left before their ends
    _, _, later = topk.contenders(q, topk.Lists(c), 21, floor=np.sort(wanted, axis=0)[-21])
    assert later <= read


def test_bounds_come_from_what_was_read_alone():
    rng = np.random.default_rng(5)
    c = np.floor(20 * rng.normal(size=(700, 8))).astype(np.int32)
    q = np.floor(20 * rng.normal(size=(6, 8)))
    lists = topk.Lists(c)
    queries, wanted = topk.Queries(q, lists), (c @ q.T).T
    for share in (0.2, 0.5, 0.8):
        lists.advance(share)
        assert (queries.upper(np.arange(6)) >= wanted).all() and (queries.lower(np.arange(6)) <= wanted).all()
        assert lists.read == lists.met.sum() == lists.at.sum() < 2 * c.size
        assert not lists.lost[lists.met == 0].any()  # nothing is known but what was read
    lists.advance(1.0)
    assert (queries.upper(np.arange(6)) == wanted).all() and (queries.lower(np.arange(6)) == wanted).all()


def test_candidates_are_not_copied_for_every_few_queries(spark):
    """One block of queries up to its size: the dealt rows grow in proportion."""
    import inspect

    blocks = inspect.signature(topk.top_k).parameters["queries_in_block"].default
    assert blocks * 64 >= 1 << 20


@pytest.mark.parametrize("part_bytes", [32 << 20, 400])
def test_shards_hold_all_rows_in_equal_bytes(spark, part_bytes):
    random.seed(6)
    docs = [(i, "x" * random.randrange(60)) for i in range(3000)]
    docs += [(77, "same text")] * 2000 + [(None, None), (None, ""), (5000, None), (5001, "y" * 500)]
    own = ("_k", "_m", "_p", "_part", "k", "before")
    frame = spark.createDataFrame(docs, DOCS).withColumns({"shard": F.lit("clash"), **{c: F.lit(c) for c in own}}).repartition(7)
    found = sharding.histogram_sort(frame, part_bytes=part_bytes).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(docs)
    assert all(r["size"] == len(r.text or "") + 8 and all(r[c] == c for c in own) for r in found)
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(24))
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    sizes = [sum(r["size"] for r in rows) for rows in by.values()]
    assert max(sizes) - min(sizes) <= 2 * (508 + 0.002 * sum(sizes) / 24)
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    assert all(max(map(key, by[s])) <= min(map(key, by[s + 1])) for s in range(23))
    if part_bytes > 400:  # a shard of one part is sorted within, too
        order = [key(r) for s in range(24) for r in sorted(by[s], key=lambda r: r.slot)]
        assert order == sorted(order)


def test_the_sharding_query_has_all_seven_columns(spark):
    from tests.support import SMALL

    found = sharding.op9_sharding(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id").text
    assert list(found.columns) == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(found.doc_id) == sorted(docs.index) and set(found.law) == {"bytes"} and found.grown_shard.isna().all()
    for r in found.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard")) and found.shard.between(0, 23).all()


def test_rows_move_once(spark):
    plan = sharding.histogram_sort(spark.createDataFrame([(i, "a" * i) for i in range(50)], DOCS))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert len(moved) == 1 and "REPARTITION" in moved[0]


def test_fewer_rows_than_shards(spark):
    found = sharding.histogram_sort(spark.createDataFrame([(1, "a"), (2, "b")], DOCS)).collect()
    assert len({r.shard for r in found}) == 2 and {r.slot for r in found} == {0}


@pytest.mark.parametrize(("window", "open_windows"), [(1024, 256), (16, 2)])
def test_packing_is_a_round_trip(spark, window, open_windows):
    random.seed(8)
    texts = [" ".join(random.choices(["the", "Straße", "x1", "\n\n", "日本", "it's", "  "], k=random.choice([0, 1, 5, 40, 700]))) for _ in range(80)]
    docs = [*enumerate(texts), (500, None), (501, ""), (502, "<|endoftext|> a"), (503, "a\x1cb"), (503, "a\x1cb"), (None, "no id"), (504, "a very long text " * 8000)]
    frame = spark.createDataFrame(docs, DOCS).withColumn("length", F.lit(1)).repartition(5)
    found = packing.pack(common.materialize(frame, "t"), window=window, open_windows=open_windows, fan_in=2).collect()
    encode = packing.Encoder(packing.default_tokenizer()).tokenizer
    wanted = {}
    for d, t in docs:
        wanted.setdefault(d, []).append(np.array([*encode.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    for d, whole in wanted.items():
        assert sum(r.length for r in pieces[d]) * 4 == sum(map(len, whole))
        if len(whole) == 1:
            assert b"".join(r.ids for r in sorted(pieces[d], key=lambda r: r.start)) == whole[0]
            assert {r.doc_tokens * 4 for r in pieces[d]} == {len(whole[0])}
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window


def test_little_is_padded(spark):
    from tests.support import SMALL

    found = packing.op10_packing(spark, SMALL).toPandas()
    fill = found.groupby("sequence_id").length.sum()
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in fill) <= 0.05 * fill.sum()
    text = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id = 3").first().text
    ids = np.array([*packing.Encoder(packing.default_tokenizer()).tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
    for r in found[found.doc_id == 3].itertuples():
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_other_tokenizers_go_the_usual_way():
    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encode.fast is None
    assert np.frombuffer(encode("Hello  World"), "<u4").tolist() == encode.tokenizer.encode("Hello  World", add_special_tokens=False).ids


@pytest.mark.parametrize("options", [{}, {"cutoff": 2}, {"fragment_rows": 150, "hot_rows": 150}, {"fragment_rows": 150, "hot_rows": 150, "cutoff": 2}])
def test_backoff_scores_equal_brute_force(spark, options):
    random.seed(9)
    docs = [(i, " ".join(random.choices(["The", "of", "the", "a", "É", f"w{i % 9}"], weights=[9, 5, 9, 3, 1, 2], k=random.choice([0, 1, 2, 3, 30, 90])))) for i in range(70)]
    docs += [(200, None), (201, "\n"), (5, docs[5][1]), (None, "the of"), (202, "word " * 3000)]
    words = [re.findall(r"[^\x20\x09-\x0D]+", _lower(t)) for _, t in docs]
    c3, cuv, c2, cv, c1 = Counter(), Counter(), Counter(), Counter(), Counter()
    rows = [list(zip(["", "", *w][: len(w)], ["", *w][: len(w)], w, strict=True)) for w in words]
    for u, v, w in (x for r in rows for x in r):
        c3[u, v, w] += 1
        cuv[u, v] += 1
        c2[v, w] += 1
        cv[v] += 1
        c1[w] += 1
    n, least = sum(c1.values()), options.get("cutoff", 1)
    score = lambda u, v, w: math.log(c3[u, v, w] / cuv[u, v]) if c3[u, v, w] >= least else math.log(0.4 * c2[v, w] / cv[v]) if c2[v, w] >= least else math.log(0.16 * c1[w] / n)
    wanted = sorted((repr(d), len(r), round(sum(score(*x) for x in r), 4)) for (d, _), r in zip(docs, rows, strict=True))
    frame = spark.createDataFrame(docs, DOCS).withColumns({"word": F.lit(1), "key": F.lit(2)}).repartition(4)
    found = lm_score.backoff_scores(frame, **options).collect()
    got = sorted((repr(r.doc_id), r.n_words, round(r.log_score, 4)) for r in found)
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    assert all(math.isclose(a[2], b[2], abs_tol=2e-4) for a, b in zip(got, wanted, strict=True))
