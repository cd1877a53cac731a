"""Index maintenance from change events, in Structured Streaming."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodestone.operators import index as I
from lodestone.plans.diagnostics import LOG
from lodestone.sources import index_store
from lodestone.sources import notes as notes_source

#: Fixed value, in milliseconds: quiet time before an index run.
INDEX_GAP = 1800
#: Fixed value, in seconds: the least time between checkpoints of a long run.
CHECKPOINT_SECONDS = 30
#: A vault has settled when after so many seconds so many comparisons in a
#: row, so far apart, find as many files; after the last try it is taken as it is.
SETTLE_SECONDS, SETTLE_SAME, SETTLE_APART, SETTLE_TRIES = 4.0, 3, 0.5, 30


def debounce(events: DataFrame, gap: str, *keys: str, watermark: str | None = None) -> DataFrame:
    """One row per burst: events closer than ``gap`` count as one. Works on tables and
    on streams (there with a watermark)."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    bursts = rows.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last"))
    return bursts.select(*keys, F.col("w.start").alias("first"), "last", "events")


def latest_wins(requests: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The newest request of each key; older ones are superseded."""
    return requests.groupBy(key).agg(*[F.max_by(c, F.struct(order, c)).alias(c) for c in columns], F.max(order).alias(order), F.count(F.lit(1)).alias("requests"))


def stale(results: DataFrame, key: str, version: str) -> DataFrame:
    """Marks results that a later version of the same key has overtaken."""
    newest = F.max(version).over(Window.partitionBy(key))
    return results.withColumn("stale", F.col(version) < newest)


def net_changes(events: DataFrame) -> DataFrame:
    """Of each file in a batch the last event alone. A rename deletes the old path and
    creates the new one; a path that is no note counts as gone."""
    old = F.col("old_file") if "old_file" in events.columns else F.lit(None).cast("string")
    own = F.struct(F.when(notes_source.is_note(F.col("file")), F.col("event")).otherwise("delete").alias("event"), "file", "mtime", "content")
    gone = F.struct(F.lit("delete").alias("event"), old.alias("file"), F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("string").alias("content"))
    moved = (F.col("event") == "rename") & old.isNotNull() & (old != F.col("file"))
    spread = events.select("ts", F.explode(F.when(moved, F.array(gone, own)).otherwise(F.array(own))).alias("e"))
    last = spread.groupBy("e.file").agg(F.max_by("e", "ts").alias("e"))
    return last.select("file", "e.event", "e.mtime", "e.content")


def publish(before: DataFrame, notes: DataFrame, actions: DataFrame, root: str, buckets: list[int] | None, **models: object) -> None:
    """Write the index after ``actions``. Files that could not be indexed are logged; the
    log names the first hundred. They are looked at again only if some are missing."""
    spark = notes.sparkSession
    index_store.save(I.apply_changes(before, notes, actions, **models), root, buckets)
    missing = I.not_applied(index_store.load(spark, root, buckets), actions)
    if not missing.isEmpty():
        for r in I.failures(notes.join(missing, "file", "left_semi"), actions, **models).orderBy("file").limit(100).collect():
            LOG.error("not indexed: %s: %s", r.file, r.error)


def apply_batch(events: DataFrame, root: str, **models: object) -> bool:
    """Apply a batch of events to the index in ``root``; whether anything was written.

    Only the buckets of the batch's files are read and written. What fails is logged
    and stays as it was.
    """
    last = net_changes(events)
    spark = events.sparkSession
    buckets = index_store.buckets_of(spark, root, last)
    index = index_store.load(spark, root, buckets)
    notes = last.filter(F.col("event") != "delete").select("file", "mtime", "content")
    actions = I.classify(notes, index.join(last.select("file"), "file", "left_semi"))
    if I.is_idle(actions):
        return False
    publish(index, notes, actions, root, buckets, **models)
    return True


def wait_settled(count: Callable[[], int], sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> int:
    """Wait until a vault that is being filled has settled; its number of files."""
    begin, before, same = clock(), count(), 0
    for _ in range(SETTLE_TRIES):
        sleep(SETTLE_APART)
        now = count()
        same = same + 1 if now == before else 0
        before = now
        if same >= SETTLE_SAME and clock() - begin >= SETTLE_SECONDS:
            break
    return before


class IndexRun:
    """A run over a whole vault, a group of buckets at a time. After each group the index
    is published, so a run that stops goes on where it was: what is done is skipped.
    Groups grow until one takes ``seconds``."""

    def __init__(self, notes: DataFrame, root: str, seconds: float = CHECKPOINT_SECONDS, changed: Callable[[str, int, int], None] | None = None, **models: object):
        self.notes, self.root, self.seconds, self.models = notes, root, seconds, models
        self.changed, self.stopping = changed or (lambda state, done, total: None), threading.Event()

    def stop(self) -> None:
        """End the run after the group it is at."""
        self.stopping.set()

    def run(self, force: bool = False) -> bool:
        """Whether the run came to its end."""
        spark = self.notes.sparkSession
        self.stopping.clear()
        total = index_store.prepare(spark, self.root, self.notes)
        width, at = 1, 0
        while at < total and not self.stopping.is_set():
            self.changed("indexing", at, total)
            begin, own = time.monotonic(), list(range(at, min(total, at + width)))
            bucket = index_store.bucket_of(F.col("file"), total)
            actions = I.classify(self.notes.filter(bucket.isin(own)), index_store.load(spark, self.root, own), force)
            stale = sorted(r[0] for r in actions.filter(F.col("action") != I.SKIP).select(bucket).distinct().collect())  # at most the group's
            if stale:
                publish(index_store.load(spark, self.root, stale), self.notes.filter(bucket.isin(stale)), actions.filter(bucket.isin(stale)), self.root, stale, **self.models)
            at += len(own)
            if time.monotonic() - begin < self.seconds:
                width *= 2
        finished = at >= total
        self.changed("ready" if finished else "offline", at, total)
        return finished

    def rebuild(self) -> bool:
        """All files anew, whatever is known of them."""
        return self.run(force=True)


class Coalesced:
    """One run at a time. Requests that come during one make it run once more; if any of
    them asks for force, that run is forced."""

    def __init__(self, run: Callable[[bool], object]):
        self.run, self.lock, self.busy, self.again, self.force = run, threading.Lock(), False, False, False

    def request(self, force: bool = False) -> bool:
        """Run, unless one is under way; whether this call ran anything."""
        with self.lock:
            if self.busy:
                self.again, self.force = True, self.force or force
                return False
            self.busy = True
        try:
            while True:
                self.run(force)
                with self.lock:
                    if not self.again:
                        self.busy = False
                        return True
                    self.again, force, self.force = False, self.force, False
        except BaseException:
            with self.lock:
                self.busy = self.again = self.force = False
            raise


def maintain(events: DataFrame, root: str, checkpoint: str, once: bool = False, **models: object) -> StreamingQuery:
    """Follow an event stream. Batches run one at a time, and what arrives during one
    waits for the next; a batch that is run again finds its files unchanged."""
    writer = events.writeStream.foreachBatch(lambda batch, _: apply_batch(batch, root, **models)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{INDEX_GAP} milliseconds")).start()
