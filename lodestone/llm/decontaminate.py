"""Benchmark decontamination by a prefix-filtered join, in DataFrame functions alone.

A window is ``window`` consecutive words of an item (an item of fewer words is one
window). A document word is hit if it lies in any occurrence of a window. The join
works on shingles of ``shingle`` words:

1. One pass over the documents keeps the shingles that occur in the benchmark at
   all, with their places, and each document's number of words.
2. Shingles are ordered by rarity: how often the documents have them, ties by hash.
   All shingles of a window must be there, so its necessary prefix is one shingle,
   the rarest. Only those are joined.
3. A joined prefix fixes the place of the item in the document. Bounds: a window
   around the prefix must lie in the document.
4. For the documents that remain, all kept shingles are laid along the item's
   place. Runs as long as a window's shingles are occurrences; the words that they
   cover are hit.

Cases: null and empty texts have no words and are clean; repeated rows and equal
ids are judged row by row; long texts are whole rows of words, exploded, never
gathered; benchmark rows without words have no window; what occurs of an item without
an id is hit, but adds nothing to the list of items; items may share an id; an empty
benchmark leaves all clean; further columns are ignored. Words are compared by 64-bit
hashes of three in a row; a word that differs changes up to three of them, all of which
would have to collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many benchmark shingles (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z-lowered text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), "")


def _key(words: str, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(words, at + i) for i in range(length)])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_shingles(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """item, item_id, ipos, key, k (words in a shingle), span (words in a window), m (shingles)."""
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), words_of(F.col("text")).alias("w"))
    items = items.filter(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(shingle))).withColumn("span", F.least(F.size("w"), F.lit(window)))
    placed = items.withColumn("m", F.size("w") - F.col("k") + 1).withColumn("ipos", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    key = F.coalesce(*[F.when(F.col("k") == n, _key("w", F.col("ipos"), n)) for n in range(1, shingle + 1)])
    return placed.select("item", "item_id", "ipos", key.alias("key"), "k", "span", "m")


def kept_shingles(docs: DataFrame, keys: DataFrame, lengths: list[int], n_keys: int, id_column: str, row: str | None) -> DataFrame:
    """rid, doc_id, n_words, pos, key: one row with pos -1 for each document, and one
    for each place of a shingle that the benchmark has."""
    number = F.col(row) if row else F.monotonically_increasing_id()  # read once: what follows reads the table written of it
    rows = docs.select(number.alias("rid"), F.col(id_column).alias("doc_id"), words_of(F.col("text")).alias("w"))
    rows = rows.withColumn("n_words", F.size("w"))
    spread = rows.select("rid", "doc_id", "n_words", "w", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)).alias("pos"))
    head = F.col("pos") < 0
    made = [F.when(~head, _key("w", F.col("pos"), n)) for n in lengths]
    if len(made) == 1:
        spread = spread.select("rid", "doc_id", "n_words", "pos", made[0].alias("key"))
    else:  # short items: shingles of several lengths at each place
        spread = spread.select("rid", "doc_id", "n_words", "pos", F.explode(F.when(head, F.array(F.lit(None).cast("long"))).otherwise(F.array(*made))).alias("key"))
    joined = spread.join(_small(keys.withColumnRenamed("key", "known"), n_keys), F.col("key") == F.col("known"), "left")
    return joined.filter((F.col("pos") < 0) | F.col("known").isNotNull()).select("rid", "doc_id", "n_words", "pos", F.col("known").alias("key"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3, id_column: str = "doc_id", row: str | None = None) -> DataFrame:
    """rid, doc_id, n_words, n_hit, items (ids of occurring items, sorted as strings).

    ``rid``: the column ``row`` if it is given, else a number made here.
    """
    items = materialize(item_shingles(benchmark, window, shingle), "bench")
    lengths = [r.k for r in items.select("k").distinct().orderBy("k").collect()] or [shingle]  # at most ``shingle`` of them
    n = items.count()
    kept = materialize(kept_shingles(docs, items.select("key").distinct(), lengths, n, id_column, row), "kept")
    heads, hits = kept.filter("pos < 0"), kept.filter("pos >= 0")

    # rarity over all documents; a window with a shingle that none has cannot occur
    rarity = hits.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    ranked = items.join(rarity, "key", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    inside = ranked.withColumn("s", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - (F.col("span") - F.col("k"))), F.least(F.col("ipos"), F.col("m") - 1 - (F.col("span") - F.col("k"))))))
    prefix = inside.groupBy("item", "s", "span").agg(F.min(F.struct("df", "key", "ipos")).alias("p")).filter("p.df > 0")
    anchors = prefix.groupBy(F.col("p.key").alias("key"), "item", F.col("p.ipos").alias("ipos"), "span").agg(F.min("s").alias("s_min"), F.max("s").alias("s_max"))

    place = F.col("pos") - F.col("ipos")
    found = hits.join(_small(anchors, n), "key").filter((place + F.col("s_max") >= 0) & (place + F.col("s_min") + F.col("span") <= F.col("n_words")))
    places = materialize(found.select("rid", "item", place.alias("place")).distinct(), "places")

    laid = hits.join(places.select("rid").distinct(), "rid", "left_semi").join(_small(items, n), "key")
    laid = laid.select("rid", "item", "item_id", (F.col("pos") - F.col("ipos")).alias("place"), "ipos", "k", "span")
    laid = laid.join(places, ["rid", "item", "place"], "left_semi")
    along = Window.partitionBy("rid", "item", "place").orderBy("ipos")
    runs = laid.withColumn("run", F.col("ipos") - F.row_number().over(along)).groupBy("rid", "item", "item_id", "place", "run", "k", "span")
    runs = runs.agg(F.min("ipos").alias("a"), F.max("ipos").alias("b")).filter(F.col("b") - F.col("a") + F.col("k") >= F.col("span"))
    spans = runs.select("rid", F.col("item_id").cast("string").alias("item_id"), (F.col("place") + F.col("a")).alias("lo"), (F.col("place") + F.col("b") + F.col("k")).alias("hi"))

    before = Window.partitionBy("rid").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(F.max("hi").over(before), F.col("lo"))))
    judged = spans.withColumn("new", new).groupBy("rid").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    return heads.select("rid", "doc_id", F.col("n_words").cast("long").alias("n_words")).join(judged, "rid", "left").select(
        "rid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def contaminated() -> Column:
    """At least a twentieth of the words, and at least one, is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
x AS (SELECT item_id, least(len(w), 13) AS n, w, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS s FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS g FROM x),
p AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
o AS (SELECT doc_id, item_id, s, p.n FROM p JOIN iw ON p.n = iw.n AND array_to_string(p.w[s + 1 : s + p.n], ' ') = iw.g),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM o GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
