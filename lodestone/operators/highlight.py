"""Semantic highlights: which candidate phrases of a hit are worth marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vector as V

# What anchors and words add; how far under the threshold they let pass.
ANCHOR_CONFIDENCE, ANCHOR_RANK, MULTI_RANK, WORD_RANK = 0.025, 0.05, 0.02, 0.012
ADJECTIVE_OVER, ANCHOR_UNDER, EXPRESSION_UNDER = 0.06, 0.1, 0.05
#: Most phrases per field (the body's is a parameter).
FILENAME_MOST, HEADING_MOST = 2, 2
#: Fixed value: most results that get highlights.
MOST_RESULTS = 15


def score_candidates(candidates: DataFrame, query: Column, query_vector: Column) -> DataFrame:
    """Adds anchors, direct, confidence and rank_score to candidates with a vector."""
    lemmas = F.array_distinct(F.transform(T.sentence_words(F.col("phrase")), lambda w: w["lemma"]))
    rows = candidates.withColumn("anchors", F.size(F.array_intersect(lemmas, T.query_anchors(query)))).withColumn("direct", V.dot_quantized(query_vector, F.col("vector")))
    rows = rows.withColumn("confidence", F.col("direct") + F.col("anchors") * ANCHOR_CONFIDENCE)
    multi = F.when(F.col("words") > 1, MULTI_RANK).otherwise(0.0)
    return rows.withColumn("rank_score", F.col("confidence") + F.col("anchors") * ANCHOR_RANK + multi + F.col("words") * WORD_RANK + F.col("quality"))


def accepted(single_min: float = 0.62, phrase_min: float = 0.56) -> Column:
    """Whether a scored candidate may be marked at all."""
    bar = F.when(F.col("words") == 1, F.lit(single_min)).otherwise(F.lit(phrase_min))
    bare = F.col("adjective_only") & (F.col("anchors") == 0) & (F.col("direct") < bar + ADJECTIVE_OVER)
    anchored = (F.col("anchors") > 0) & (F.col("direct") >= bar - ANCHOR_UNDER)
    expressive = (F.col("words") > 1) & (F.col("has_noun") | F.col("has_expression")) & (F.col("direct") >= bar - EXPRESSION_UNDER)
    return ~bare & ((F.col("confidence") >= bar) | anchored | expressive)


def choose(items: Column, most: Column | int) -> Column:
    """From items in rank order those that overlap no chosen one of their sentence."""

    def overlaps(a: Column, b: Column) -> Column:
        return (a["sentence_id"] == b["sentence_id"]) & ~((a["end"] < b["start"]) | (a["start"] > b["end"]))

    none = F.slice(items, 1, 0)
    return F.aggregate(
        items, none, lambda chosen, x: F.when((F.size(chosen) >= most) | F.exists(chosen, lambda c: overlaps(x, c)), chosen).otherwise(F.array_append(chosen, x))
    )


def select_highlights(scored: DataFrame, keys: list[str], max_phrases: int = 3, single_min: float = 0.62, phrase_min: float = 0.56) -> DataFrame:
    """Chosen phrases per group and field: an array of (phrase, score) in rank order.

    A passage has at most 40 candidates, so a group's array is small.
    """
    item = F.struct((-F.col("rank_score")).alias("r"), "pos", "sentence_id", "start", "end", "phrase", "confidence")
    most = F.when(F.col("field") == "filename", FILENAME_MOST).when(F.col("field") == "heading", HEADING_MOST).otherwise(max_phrases)
    grouped = scored.filter(accepted(single_min, phrase_min)).groupBy(*keys, "field").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("most", most)
    picked = F.transform(choose(F.col("items"), F.col("most")), lambda x: F.struct(x["phrase"].alias("phrase"), x["confidence"].alias("score")))
    return grouped.select(*keys, "field", picked.alias("highlights"))


def highlight_hits(hits: DataFrame, candidates: DataFrame, query: str, query_vector: Column, result_min: float = 0.55, limit: int = MOST_RESULTS, **options: float) -> DataFrame:
    """passage_id with filename_, heading_ and semantic_highlights, for the best hits
    whose similarity reaches ``result_min``."""
    most = max(1, min(MOST_RESULTS, limit or MOST_RESULTS))
    best = hits.orderBy(F.desc("ranking_score"), "passage_id").limit(most).filter(F.col("semantic_score") >= result_min).select("passage_id")
    own = candidates.join(F.broadcast(best), "passage_id")  # at most 15 rows
    chosen = select_highlights(score_candidates(own, F.lit(query), query_vector), ["passage_id"], **options)
    wide = chosen.groupBy("passage_id").pivot("field", ["filename", "heading", "body"]).agg(F.first("highlights"))
    return wide.select("passage_id", F.col("filename").alias("filename_highlights"), F.col("heading").alias("heading_highlights"), F.col("body").alias("semantic_highlights"))
