"""Hits to what a reader sees: note cards, passages, snippets, phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: Fixed value: snippets on a card.
MOST_SNIPPETS = 3
#: Fixed value: raw hits that a search may ask for.
MOST_HITS = 1000


def cleaned_phrases(highlights: Column) -> Column:
    """The phrases of an array of (phrase, score), cleaned, without empty ones."""
    phrases = F.transform(F.coalesce(highlights, F.array().cast("array<struct<phrase:string,score:double>>")), lambda h: T.clean_for_reader(h["phrase"]))
    return F.filter(phrases, lambda p: p != "")


def _snippets(hits: DataFrame, query: str) -> DataFrame:
    rows = hits.withColumns(
        {f"_{n}": cleaned_phrases(F.col(f"{n}_highlights")) if f"{n}_highlights" in hits.columns else F.array().cast("array<string>") for n in ("semantic", "filename", "heading")}
    )
    return rows.withColumn("_snippet", T.distill_snippet(F.col("text"), F.lit(query), F.col("_semantic")))


def group_by_note(hits: DataFrame, query: str, most_files: int) -> DataFrame:
    """A card per note, in the order of each note's best hit.

    A card takes its scores from its best-ranked hit; its ``semantic_score`` is that
    hit's ``score``, boosts included. It has the first three distinct snippets in rank
    order, and no card is made of a note without one.
    """
    best = hits.orderBy(F.desc("ranking_score"), "passage_id").limit(MOST_HITS)
    rank = F.row_number().over(Window.orderBy(F.desc("ranking_score"), "passage_id"))  # of at most MOST_HITS rows
    rows = _snippets(best, query).withColumn("rank", rank)
    own = Window.partitionBy("file", "_snippet").orderBy("rank")
    firsts = rows.withColumn("_new", (F.row_number().over(own) == 1) & (F.col("_snippet") != ""))
    snippet = F.when(
        F.col("_new"),
        F.struct("rank", F.col("_snippet").alias("text"), "heading", "score", "line_start", "line_end", F.col("_semantic").alias("semantic_highlights"), F.col("_heading").alias("heading_highlights")),
    )
    first = lambda c: F.min_by(c, "rank")
    names = F.array_sort(F.collect_list(F.struct("rank", F.col("_filename").alias("f"))))
    cards = firsts.groupBy("file").agg(
        F.min("rank").alias("rank"),
        first("ranking_score").alias("score"),
        first("score").alias("semantic_score"),
        first("filename_boost").alias("filename_boost"),
        first("folder_path_boost").alias("folder_path_boost"),
        F.slice(F.array_sort(F.collect_list(snippet)), 1, MOST_SNIPPETS).alias("snippets"),
        F.array_distinct(F.flatten(F.transform(names, lambda x: x["f"]))).alias("filename_highlights"),
    )
    return cards.filter(F.size("snippets") > 0).orderBy("rank").limit(most_files).withColumn("snippets", F.transform("snippets", lambda s: s.dropFields("rank")))


def by_passage(hits: DataFrame, query: str, most: int) -> DataFrame:
    """One snippet per hit of the best ``most``; hits without one go."""
    best = hits.orderBy(F.desc("ranking_score"), "passage_id").limit(most)
    rows = _snippets(best, query).filter(F.col("_snippet") != "")
    return rows.select("passage_id", "file", "heading", "score", "semantic_score", "line_start", "line_end", F.col("_snippet").alias("snippet"), F.col("_semantic").alias("semantic_highlights"))


def phrase_pool(hits: DataFrame) -> DataFrame:
    """Distinct highlight phrases over all hits, in first-seen order and casing."""
    fields = F.concat(*[cleaned_phrases(F.col(f"{n}_highlights")) for n in ("filename", "heading", "semantic")])
    spread = hits.select("passage_id", "ranking_score", F.posexplode(fields).alias("pos", "phrase"))
    seen = Window.partitionBy(F.lower("phrase")).orderBy(F.desc("ranking_score"), "passage_id", "pos")
    return spread.withColumn("n", F.row_number().over(seen)).filter("n = 1").orderBy(F.desc("ranking_score"), "passage_id", "pos").select("phrase")
