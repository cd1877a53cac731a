import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import embed
from lodestone.operators import index as I
from lodestone.sources import index_store, notes
from lodestone.streaming import updates

NOTES = "file string, mtime long, content string"


def _notes(spark, rows):
    return spark.createDataFrame(rows, NOTES)


def _state(index):
    rows = index.select("file", "chunk_no", "text", "mtime", "content_hash", F.size("candidates").alias("c"), F.transform("embedding", lambda x: F.round(x, 4)).alias("e")).collect()
    return sorted((r.file, r.chunk_no, r.text, r.mtime, r.content_hash, r.c, tuple(r.e)) for r in rows)


def test_actions(spark):
    before = _notes(spark, [(f"{n}.md", 1, f"text {n}") for n in ("same", "touched", "changed", "gone")])
    index = I.build_passages(before)
    now = _notes(spark, [("same.md", 1, "anything"), ("touched.md", 2, "text touched"), ("changed.md", 2, "new"), ("added.md", 1, "x")])
    found = {r.file: r.action for r in I.classify(now, index).collect()}
    assert found == {"same.md": "SKIP", "touched.md": "TOUCH", "changed.md": "UPSERT", "gone.md": "DELETE", "added.md": "UPSERT"}
    assert {r.action for r in I.classify(now, index, force=True).collect()} == {"UPSERT", "DELETE"}
    old = index.withColumn("highlight_version", F.lit(0))
    assert {r.file: r.action for r in I.classify(now, old).collect()}["same.md"] == "UPSERT"
    unhashed = index.withColumn("content_hash", F.lit(None).cast("string"))
    found = {r.file: r.action for r in I.classify(now, unhashed).collect()}
    assert found["touched.md"] == "TOUCH" and found["changed.md"] == "UPSERT"


def test_unchanged_files_are_not_read(spark):
    """No Python function gets a row whose time and rules are as before."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def content(text):
        read.add(1)
        return text

    before = _notes(spark, [(f"{n}.md", 1, f"text {n}") for n in range(20)])
    index = spark.createDataFrame(I.build_passages(before).collect(), index_store.SCHEMA)
    now = _notes(spark, [(f"{n}.md", 2 if n < 3 else 1, f"text {n}") for n in range(20)]).withColumn("content", content.asNondeterministic()("content"))
    found = {r.file: r.action for r in I.classify(now, index).collect()}
    assert sorted(found.values()) == ["SKIP"] * 17 + ["TOUCH"] * 3 and len(found) == 20
    plan = I.classify(_notes(spark, [("a.md", 1, "x")]), index)._jdf.queryExecution().executedPlan().toString()
    python = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert python and all("_chunk" in line or "_fingerprints" in line for line in python)


class Choosy(embed.HashingEmbedder):
    def embed(self, texts):
        if any("poison" in t for t in texts):
            raise ValueError("no such text")
        return super().embed(texts)


def test_a_failing_file_does_not_end_the_run(spark, tmp_path, caplog):
    choosy = embed.careful_embedder(model=Choosy)
    rows = [("a.md", 1, "good"), ("b.md", 1, "poison"), ("c.md", 1, "fine"), ("d.md", 1, "# One\n\n" + "x" * 1500 + "\n\n# Two\n\npoison " + "y" * 1500)]
    assert {r.file for r in I.build_passages(_notes(spark, rows), embed_text=choosy).collect()} == {"a.md", "c.md"}
    root = str(tmp_path / "index")
    events = [("create", f, datetime(2024, 1, 1), m, c) for f, m, c in rows]
    schema = "event string, file string, ts timestamp, mtime long, content string"
    with caplog.at_level("ERROR"):
        assert updates.apply_batch(spark.createDataFrame(events, schema), root, embed_text=choosy)
    assert caplog.text.count("not indexed") == 2 and "b.md: ValueError: no such text" in caplog.text
    read = lambda: {r.file: r.text for r in index_store.load(spark, root).select("file", "text").collect()}
    assert read() == {"a.md": "good", "c.md": "fine"}
    caplog.clear()
    changed = [("modify", f, datetime(2024, 1, 2), 2, c) for f, c in (("a.md", "poison"), ("c.md", "finer"), ("b.md", "cured"))]
    with caplog.at_level("ERROR"):
        updates.apply_batch(spark.createDataFrame(changed, schema), root, embed_text=choosy)
    assert read() == {"a.md": "good", "b.md": "cured", "c.md": "finer"} and caplog.text.count("not indexed") == 1


def test_a_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_store, "BUCKET_ROWS", 8)
    notes_ = _notes(spark, [(f"{i}.md", 1, f"text {i}") for i in range(20)])
    seen, root = [], str(tmp_path / "index")
    run = updates.IndexRun(notes_, root, seconds=0, changed=lambda *state: (seen.append(state), run.stop() if len(seen) == 2 else None))
    assert not run.run()
    first = index_store.manifest(spark, root)
    done = index_store.load(spark, root).count()
    assert first.buckets == 10 and 0 < done < 20 and seen[-1][0] == "offline"
    assert updates.IndexRun(notes_, root, seconds=60).run()
    last = index_store.manifest(spark, root)
    assert index_store.load(spark, root).count() == 20
    assert all(last.versions[b] == v for b, v in first.versions.items())  # what was done is not done again
    counts = I.status(index_store.load(spark, root), I.classify(notes_, index_store.load(spark, root))).first()
    assert (counts.files, counts.vault_files, counts.stale_files, counts.processed_files) == (20, 20, 0, 20)
    assert updates.IndexRun(notes_, root, seconds=60).rebuild()
    assert min(index_store.manifest(spark, root).versions.values()) > max(last.versions.values())


def test_requests_during_a_run_are_one_more_run():
    ran = []

    def run(force):
        ran.append(force)
        if len(ran) == 1:
            assert not runs.request() and not runs.request(force=True) and not runs.request()

    runs = updates.Coalesced(run)
    assert runs.request() and ran == [False, True] and runs.request(True) and ran[-1]


def test_a_vault_settles():
    now, counts = [0.0], iter([1, 5, 5, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9])
    assert updates.wait_settled(lambda: next(counts), sleep=lambda s: now.__setitem__(0, now[0] + s), clock=lambda: now[0]) == 9 and now[0] >= 4
    busy = iter(range(100))
    assert updates.wait_settled(lambda: next(busy), sleep=lambda s: None, clock=lambda: 0.0) == 30


def test_the_last_vector_of_a_phrase_stands(spark):
    one = lambda file, no, *items: (file, no, [(p, "body", 0, 0, 0, 1, True, False, False, False, 0.1, [v]) for p, v in items])
    rows = spark.createDataFrame([one("a", 0, ("Free will", 1), ("x", 2)), one("a", 1, (" free WILL", 3)), one("B", 5, ("free will", 9))], f"file string, chunk_no int, candidates array<{index_store.CANDIDATE}>")
    assert {r.phrase_key: r.vector for r in embed.phrase_dictionary(rows).collect()} == {"free will": [3], "x": [2]}


def test_updates_equal_a_rebuild(spark, tmp_path):
    random.seed(5)
    state, index = {}, spark.createDataFrame([], index_store.SCHEMA)
    for turn in range(3):
        for _ in range(4):
            name = f"{random.randrange(5)}.md"
            if random.random() < 0.3:
                state.pop(name, None)
            else:
                state[name] = f"words of {name} in turn {turn}"
        rows = _notes(spark, [(n, turn, c) for n, c in state.items()])
        actions = I.classify(rows, index)
        index = I.apply_changes(index, rows, actions)
        index_store.save(index, str(tmp_path / "index"))
        index = index_store.load(spark, str(tmp_path / "index"))
        assert _state(index) == _state(I.build_passages(rows))


def test_store_round_trip_and_damage(spark, tmp_path):
    root = str(tmp_path / "index")
    assert index_store.load(spark, root).count() == 0
    index = I.build_passages(_notes(spark, [("a.md", 1, "Free will decides. Agency stays.")]))
    assert index_store.save(index, root) == 1 and index_store.save(index, root) == 2
    stored = index_store.load(spark, root)
    assert _state(stored) == _state(index)
    assert [len(c.vector) for c in stored.first().candidates] == [64] * len(stored.first().candidates)
    assert index_store.require_valid(stored, 64) is stored
    with pytest.raises(index_store.DamagedIndex):
        index_store.require_valid(stored.withColumn("embedding", F.slice("embedding", 1, 3)), 64)
    (tmp_path / "torn" / "v000000001").mkdir(parents=True)  # without its manifest
    with pytest.raises(index_store.DamagedIndex):
        index_store.load(spark, str(tmp_path / "torn"))


def test_vault_scan(spark, tmp_path):
    for name, text in (("a.md", "A"), ("sub/b.TXT", "B"), ("c.png", "P"), ("d.markdown", "D")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = {r.file: r.content for r in notes.scan_vault(spark, str(tmp_path)).collect()}
    assert found == {"a.md": "A", "sub/b.TXT": "B", "d.markdown": "D"}
    assert [r.path for r in notes.attachments(spark, str(tmp_path)).collect()] == ["c.png"]
    assert notes.folder_size(spark, str(tmp_path)).first().bytes == 4


def test_statistics_and_health(spark):
    stats = I.statistics(I.build_passages(_notes(spark, [("a.md", 1, "Free will."), ("b.md", 1, "Agency.")]))).first()
    assert (stats.files, stats.passages) == (2, 2) and stats.vector_bytes == 2 * 64 * 4 + stats.phrases * 64 * 2
    assert I.statistics(spark.createDataFrame([], index_store.SCHEMA)).first().passages == 0


def test_stream_of_events_keeps_the_index(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / n) for n in ("events", "index", "checkpoint"))
    (tmp_path / "events").mkdir()

    def write(name, *events):
        lines = [json.dumps({"event": e, "file": f, "ts": f"2024-01-01T00:00:{i:02d}", "mtime": m, "content": c}) for i, (e, f, m, c) in enumerate(events)]
        (tmp_path / "events" / name).write_text("\n".join(lines))

    def run():
        updates.maintain(notes.event_stream(spark, source), root, checkpoint, once=True).awaitTermination()
        return {r.file: r.text for r in index_store.load(spark, root).select("file", "text").collect()}

    write("1.json", ("create", "a.md", 1, "first"), ("modify", "a.md", 2, "second"), ("create", "b.md", 1, "b"), ("create", "x.png", 1, "no note"))
    assert run() == {"a.md": "second", "b.md": "b"}
    write("2.json", ("delete", "b.md", None, None), ("modify", "a.md", 3, "second"))
    assert run() == {"a.md": "second"}
    before = len(list((tmp_path / "index").iterdir()))
    number, _, versions = index_store.manifest(spark, root)
    assert number == 2 and set(versions.values()) <= {1, 2}
    write("3.json", ("modify", "a.md", 3, "second"))
    assert run() == {"a.md": "second"} and len(list((tmp_path / "index").iterdir())) == before
    (tmp_path / "events" / "4.json").write_text(json.dumps({"event": "rename", "file": "sub/c.md", "old_file": "a.md", "ts": "2024-01-01T00:00:00", "mtime": 4, "content": "second"}))
    assert run() == {"sub/c.md": "second"}
    (tmp_path / "events" / "5.json").write_text(json.dumps({"event": "rename", "file": "c.png", "old_file": "sub/c.md", "ts": "2024-01-01T00:00:00", "mtime": 5, "content": None}))
    assert run() == {}


def test_debounce_runs_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:01:00"), (1, "2024-01-01 02:00:00")], "k int, ts string").selectExpr("k", "cast(ts as timestamp) ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = updates.debounce(stream, "1800 milliseconds", "k", watermark="1 minute").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.events for r in spark.table("bursts").collect())[-1] == 2


def test_packed_files_are_imported(spark, tmp_path):
    import numpy as np

    from lodestone.sources import legacy

    candidate = {"phrase": "free will", "field": "body", "sentenceId": 0, "start": 0, "end": 1, "words": 2, "hasNoun": True, "hasVerb": False, "hasExpression": False, "adjectiveOnly": False, "quality": 0.09}
    meta = [{"file": "test.md", "heading": "", "text": f"t{i}", "lineStart": 0, "lineEnd": 0, "mtime": 1, "contentHash": "h", "highlightVersion": 1, "highlightCandidates": [candidate] * i} for i in range(3)]
    (tmp_path / "index.meta.json").write_text(json.dumps(meta))
    (tmp_path / "index.vectors.bin").write_bytes(np.full(3 * 384, 0.25, "<f4").tobytes())
    (tmp_path / "index.highlights.bin").write_bytes(np.full(3 * 384, 16384, "<i2").tobytes())
    found = legacy.read_packed_index(spark, str(tmp_path), 384).orderBy("chunk_no").collect()
    assert [(r.text, len(r.candidates), len(r.embedding)) for r in found] == [("t0", 0, 384), ("t1", 1, 384), ("t2", 2, 384)]
    assert found[1].candidates[0].vector[0] == 16384
    (tmp_path / "index.vectors.bin").write_bytes(b"torn")
    with pytest.raises(index_store.DamagedIndex):
        legacy.read_packed_index(spark, str(tmp_path), 384)
    root = str(tmp_path / "new")
    with pytest.raises(index_store.DamagedIndex):
        legacy.migrate(spark, str(tmp_path), root, 384)
    assert (tmp_path / "index.meta.json").exists()
    (tmp_path / "index.vectors.bin").write_bytes(np.full(3 * 384, 0.25, "<f4").tobytes())
    legacy.migrate(spark, str(tmp_path), root, 384)
    assert index_store.load(spark, root).count() == 3 and not list(tmp_path.glob("index.*"))


def test_diagnostics():
    import logging

    from lodestone.plans import diagnostics

    ring = diagnostics.RingHandler(60)
    ring.addFilter(diagnostics.OnceFilter())
    log = logging.Logger("test")
    log.addHandler(ring)
    for message in ("one", "one", "two", "x" * 30):
        log.warning(message)
    assert len(ring.lines) == 1 and ring.text().endswith("x")
    ring.clear()
    log.warning("again")
    log.warning("again")
    assert len(ring.lines) == 1
