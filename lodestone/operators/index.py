"""Keeping the index current: classify changes, apply them, count, judge health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunk, embed, phrases
from lodestone.sources.index_store import CANDIDATE, HIGHLIGHT_VERSION

SKIP, TOUCH, UPSERT, DELETE = "SKIP", "TOUCH", "UPSERT", "DELETE"


def indexed_files(index: DataFrame) -> DataFrame:
    """One row per indexed file: what deciding about it needs."""
    current = (F.coalesce(F.col("highlight_version"), F.lit(-1)) == HIGHLIGHT_VERSION) & F.col("candidates").isNotNull()
    part = F.struct("chunk_no", "heading", "text", "line_start", "line_end")
    return index.groupBy("file").agg(
        F.bool_and(current).alias("current"),
        F.bool_and(F.coalesce(F.col("content_hash"), F.lit("")) != "").alias("hashed"),
        F.min("mtime").alias("mtime_lo"),
        F.max("mtime").alias("mtime_hi"),
        F.max("content_hash").alias("known_hash"),
        # texts are needed only for files from before hashes were kept
        F.array_sort(F.collect_list(F.when(F.coalesce(F.col("content_hash"), F.lit("")) == "", part))).alias("parts"),
    )


def classify(notes: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """file, action, mtime, content_hash: what each note or indexed file calls for.

    A file whose time and rules are as before is skipped unread: what to read is decided
    on names and times alone. Of the rest the fingerprint (for files indexed without
    one, the passages) tells a touched from a changed file.
    """
    state = indexed_files(index)
    both = notes.select("file", "mtime", F.lit(True).alias("present")).join(state, "file", "full_outer")
    fresh = F.col("current") & F.col("hashed") & (F.col("mtime_lo") == F.col("mtime")) & (F.col("mtime_hi") == F.col("mtime"))
    before = F.col("current").isNotNull()
    unread = F.when(F.col("present").isNull(), DELETE).when(before & ~F.lit(force) & F.coalesce(fresh, F.lit(False)), SKIP)
    told = both.withColumn("action", unread)
    settled = told.filter(F.col("action").isNotNull()).select("file", "action", "mtime", F.when(F.col("action") == SKIP, F.col("known_hash")).alias("content_hash"))

    open_ = told.filter(F.col("action").isNull()).drop("action", "present")
    read = open_.join(notes.select("file", "content"), "file").withColumn("own", T.fingerprint(F.col("content")))
    by_text = before & ~F.lit(force) & F.col("known_hash").isNull()
    verdict = lambda equal: F.when(before & ~F.lit(force) & F.col("current") & equal, TOUCH).otherwise(UPSERT)
    hashed = read.filter(~by_text).select("file", verdict(F.col("own") == F.col("known_hash")).alias("action"), "mtime", F.col("own").alias("content_hash"))
    bare = lambda a: F.transform(a, lambda c: F.struct(c["heading"], c["text"], c["line_start"], c["line_end"]))
    equal = chunk.same_chunks(bare(F.col("parts")), bare(chunk.chunks(F.col("content"))))
    unhashed = read.filter(by_text).select("file", verdict(F.coalesce(equal, F.lit(False))).alias("action"), "mtime", F.col("own").alias("content_hash"))
    return settled.unionByName(hashed).unionByName(unhashed)


def _built(notes: DataFrame, embed_text: object = None, embed_phrase: object = None, tagger: phrases.Tagger = phrases.suffix_tagger) -> DataFrame:
    """Index rows of ``notes`` with ``error``: null, or what went wrong with the row."""
    cut = chunk.passages(notes).withColumn("passage_id", F.xxhash64("file", "chunk_no"))
    made = embed.embed_passages(cut, embed_text)
    found = phrases.candidates(cut.filter(F.col("chunk_error").isNull()).select("passage_id", "file", "heading", "text"), tagger)
    vectors = embed.embed_phrases(found, embed=embed_phrase)
    with_vector = found.withColumn("phrase_key", embed.phrase_key(F.col("phrase"))).join(vectors, "phrase_key")
    item = F.struct("pos", "phrase", "field", "sentence_id", "start", "end", "words", "has_noun", "has_verb", "has_expression", "adjective_only", "quality", "vector")
    lists = with_vector.groupBy("passage_id").agg(F.array_sort(F.collect_list(item)).alias("candidates"))  # at most 40 each
    lists = lists.withColumn("candidates", F.transform("candidates", lambda c: c.dropFields("pos")).cast(f"array<{CANDIDATE}>"))
    none = F.array().cast(f"array<{CANDIDATE}>")
    return made.join(lists, "passage_id", "left").select(
        "file", "chunk_no", "heading", "text", "line_start", "line_end", "mtime", "content_hash", F.lit(HIGHLIGHT_VERSION).alias("highlight_version"), "embedding",
        F.coalesce("candidates", none).alias("candidates"), F.coalesce("chunk_error", "error").alias("error"),
    )


def _failed(condition: Column) -> Column:
    """Whether any row of a file meets a condition."""
    return F.max(condition.cast("int")).over(Window.partitionBy("file")) == 1


def build_passages(notes: DataFrame, **models: object) -> DataFrame:
    """Index rows of all ``notes`` that can be indexed; a note that fails has none."""
    rows = _built(notes, **models).withColumn("failed", _failed(F.col("error").isNotNull()))
    return rows.filter(~F.col("failed")).drop("failed", "error")


def failures(notes: DataFrame, actions: DataFrame, **models: object) -> DataFrame:
    """file, error of the changed ``notes`` that cannot be indexed."""
    changed = notes.join(actions.filter(F.col("action") == UPSERT).select("file"), "file", "left_semi")
    return _built(changed, **models).filter(F.col("error").isNotNull()).groupBy("file").agg(F.min("error").alias("error"))


def apply_changes(index: DataFrame, notes: DataFrame, actions: DataFrame, **models: object) -> DataFrame:
    """The index after ``actions``: changed files are replaced whole, deleted ones go,
    touched ones get the new time and fingerprint. A changed file that fails keeps its
    old rows, so that the next run tries again; the others are not affected."""
    what = actions.select("file", "action", F.col("mtime").alias("new_mtime"), F.col("content_hash").alias("new_hash"))
    known = index.join(what, "file", "left").withColumn("action", F.coalesce("action", F.lit(SKIP)))
    own = ("action", "new_mtime", "new_hash")
    touch = F.col("action") == TOUCH
    kept = known.filter(F.col("action").isin(SKIP, TOUCH))
    kept = kept.withColumns({"mtime": F.when(touch, F.col("new_mtime")).otherwise(F.col("mtime")), "content_hash": F.when(touch, F.col("new_hash")).otherwise(F.col("content_hash"))})
    fresh = _built(notes.join(actions.filter(F.col("action") == UPSERT).select("file"), "file", "left_semi"), **models).withColumn("old", F.lit(False))
    before = known.filter(F.col("action") == UPSERT).drop(*own).withColumns({"error": F.lit(None).cast("string"), "old": F.lit(True)})
    either = before.unionByName(fresh).withColumn("failed", _failed(F.col("error").isNotNull()))
    return kept.drop(*own).unionByName(either.filter(F.col("old") == F.col("failed")).drop("error", "old", "failed"))


def not_applied(index: DataFrame, actions: DataFrame) -> DataFrame:
    """The changed files (file) that an index doesn't have as they are now: they failed, or
    have no text."""
    wanted = actions.filter(F.col("action") == UPSERT).select("file", "content_hash")
    return wanted.join(index.select("file", "content_hash"), ["file", "content_hash"], "left_anti").select("file")


def is_idle(actions: DataFrame) -> bool:
    """Nothing to write: every file is to be skipped."""
    return actions.filter(F.col("action") != SKIP).isEmpty()


def status(index: DataFrame, actions: DataFrame) -> DataFrame:
    """One row: the files, passages and phrases of an index, the files of the vault, how
    many of them are stale, and how many need nothing."""
    own = index.agg(
        F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("passages"), F.coalesce(F.sum(F.size("candidates").cast("long")), F.lit(0)).alias("phrases")
    )
    counts = actions.agg(
        F.count_if(F.col("action") != DELETE).alias("vault_files"), F.count_if(F.col("action") != SKIP).alias("stale_files"), F.count_if(F.col("action") == SKIP).alias("processed_files")
    )
    return own.crossJoin(F.broadcast(counts))  # one row each


def statistics(index: DataFrame) -> DataFrame:
    """One row: files, passages, candidate phrases, and the bytes that they take.

    Vectors count 4 bytes a component, candidates' 2, all else as JSON.
    """
    rest = F.to_json(F.struct("file", "heading", "text", "line_start", "line_end", "mtime", "content_hash", "highlight_version", F.transform("candidates", lambda c: c.dropFields("vector")).alias("candidates")))
    phrase_bytes = F.aggregate("candidates", F.lit(0).cast("long"), lambda s, c: s + F.size(c["vector"]) * 2)
    return index.agg(
        F.count_distinct("file").alias("files"),
        F.count(F.lit(1)).alias("passages"),
        F.coalesce(F.sum(F.size("candidates").cast("long")), F.lit(0)).alias("phrases"),
        F.coalesce(F.sum(F.size("embedding").cast("long") * 4 + phrase_bytes), F.lit(0)).alias("vector_bytes"),
        F.coalesce(F.sum(F.octet_length(rest).cast("long") + 1), F.lit(0)).alias("meta_bytes"),
    )


#: Phases in which the indexer works; seconds until it counts as stopped.
WORKING_PHASES = ("starting", "loading_model", "downloading_model", "indexing")
SILENT_SECONDS = 15


def health(phase: Column, enabled: Column, has_remote: Column, remote_indexing: Column, stale_files: Column, age_seconds: Column, done: Column, total: Column) -> Column:
    """(status, stopped, progress). ``healthy``: ready, nothing runs, no file is stale;
    ``working``: something runs and has been heard of; else ``error``, or ``disabled``
    if the index is off. Progress in percent is shown while it works."""
    indexing = F.coalesce(has_remote & remote_indexing, F.lit(False))
    stale = F.when(has_remote, F.coalesce(stale_files, F.lit(0))).otherwise(0)
    healthy = (phase == "ready") & ~indexing & (stale == 0)
    working = indexing | phase.isin(*WORKING_PHASES)
    stopped = ~has_remote & working & (age_seconds > SILENT_SECONDS)
    active = working & ~stopped
    status = F.when(healthy, "healthy").when(active, "working").when(enabled, "error").otherwise("disabled")
    progress = F.when(active & (total > 0), F.least(F.lit(100.0), done / total * 100))
    return F.struct(status.alias("status"), stopped.alias("stopped"), progress.alias("progress"))
