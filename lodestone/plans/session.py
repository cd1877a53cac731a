"""What a search session keeps on the driver: bounded caches, and latest-wins search."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import SparkSession

#: Entries of the query-vector and the result cache.
QUERY_CACHE, RESULT_CACHE = 48, 80
#: Fixed value, in seconds: quiet time before a search.
SEARCH_GAP = 0.075


class BoundedCache:
    """A cache of ``most`` entries. With ``refresh``, a hit makes an entry the newest;
    without, entries leave in the order in which they came. ``dropped`` gets each value
    that leaves."""

    def __init__(self, most: int, refresh: bool, dropped: Callable[[Any], Any] = lambda value: None):
        self.most, self.refresh, self.entries, self.dropped = most, refresh, OrderedDict(), dropped

    def get(self, key: Hashable, make: Callable[[], Any]) -> Any:
        if key in self.entries:
            if self.refresh:
                self.entries.move_to_end(key)
            return self.entries[key]
        value = make()  # an error leaves nothing behind
        self.entries[key] = value
        while len(self.entries) > self.most:
            self.dropped(self.entries.popitem(last=False)[1])
        return value

    def clear(self) -> None:
        while self.entries:
            self.dropped(self.entries.popitem(last=False)[1])


def query_cache() -> BoundedCache:
    return BoundedCache(QUERY_CACHE, refresh=False)


def result_cache() -> BoundedCache:
    """Of cached DataFrames: those that leave are freed."""
    return BoundedCache(RESULT_CACHE, refresh=True, dropped=lambda df: df.unpersist())


class Superseded(Exception):
    """A newer query took this one's place."""


class LiveSearch:
    """At most one search runs and one waits. A newer request replaces the one that
    waits and cancels the jobs of the one that runs; a superseded search finds nothing.
    A request that isn't ``immediate`` waits for ``gap`` seconds without another."""

    def __init__(self, spark: SparkSession, run: Callable[[Any], Any], gap: float = SEARCH_GAP):
        self.spark, self.run, self.gap, self.lock, self.newest = spark, run, gap, threading.Lock(), 0
        self.turn, self.running = threading.Lock(), ""

    def search(self, request: Any, immediate: bool = False) -> Any:
        with self.lock:
            self.newest += 1
            own = self.newest
        if not immediate:
            time.sleep(self.gap)
        # again and again, as a search that runs may be about to start its next job
        while not self.turn.acquire(timeout=0.1):
            with self.lock:
                if self.running and own == self.newest:
                    self.spark.sparkContext.cancelJobsWithTag(self.running)
        try:
            tag = f"live-search-{own}"
            with self.lock:
                if own != self.newest:
                    raise Superseded
                self.running = tag
            self.spark.sparkContext.addJobTag(tag)
            try:
                found = self.run(request)
            except Exception:
                if own != self.newest:  # cancelled
                    raise Superseded from None
                raise
            finally:
                self.spark.sparkContext.removeJobTag(tag)
                with self.lock:
                    self.running = ""
        finally:
            self.turn.release()
        if own != self.newest:
            raise Superseded
        return found


def page_limits(visible: int, top_k: int, one_note: bool) -> tuple[int, int]:
    """(rows asked for, raw hits to fetch). 10, 4, 40, 1000."""
    asked = max(visible, top_k)
    return asked, min(1000, asked + 10) if one_note else min(1000, max(asked * 4, 40))


def more_to_show(found: int, asked: int, raw_found: int, raw_limit: int) -> bool:
    return found > asked or (raw_found >= raw_limit and raw_limit < 1000)


def searchable(query: str) -> bool:
    """Queries of two letters or more are run."""
    return len(query.strip()) >= 2


def step(current: int, by: int, count: int) -> int:
    """The next place in a ring of matches."""
    return (current + by) % count if count else 0
