"""The similarity graph of notes, merged with explicit links, laid out and styled."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.search import block_top_k

#: Fixed value: the angle between neighbours of a phyllotaxis layout.
GOLDEN_ANGLE = math.pi * (3 - math.sqrt(5))


def centroids(passages: DataFrame) -> DataFrame:
    """file, node (order of first appearance), embedding: the normalised sum of each
    note's vectors, by component, so that sums combine before the shuffle."""
    spread = passages.select("file", "passage_id", F.posexplode("embedding").alias("i", "x"))
    sums = spread.groupBy("file", "i").agg(F.sum(F.col("x").cast("double")).alias("x"), F.min("passage_id").alias("first"))
    rows = sums.groupBy("file").agg(
        F.min("first").alias("node"),
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"),
    )
    norm = F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))
    return rows.withColumn("_n", norm).select("file", "node", F.transform("v", lambda x: x / F.col("_n")).alias("embedding"))


def knn_edges(nodes: DataFrame, k: int = 5) -> DataFrame:
    """source, target, score, rank and the source's node number: the ``k`` most similar
    others of each node, directed; ties go to the earlier node."""
    rows = nodes.select(F.col("node").alias("passage_id"), "file", F.col("embedding").cast("array<float>").alias("embedding"))
    near = block_top_k(rows, rows.withColumnRenamed("passage_id", "query_id"), k, exclude_same=True)
    names = nodes.select("node", "file")
    named = near.join(names.withColumnsRenamed({"node": "query_id", "file": "source"}), "query_id").join(names.withColumnsRenamed({"node": "passage_id", "file": "target"}), "passage_id")
    return named.select("source", "target", "score", "rank", F.col("query_id").alias("node"), F.lit(False).alias("hard"))


def capped(edges: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` edges in node order, not the best."""
    return edges.orderBy("node", "rank").limit(most)


def merge_links(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Links (source, target, count) as hard edges of score 1, in both directions if
    given so; similarity edges go where a link joins the same two notes."""
    hard = links.filter(F.col("count") != 0).select("source", "target", F.lit(1.0).alias("score"), F.lit(True).alias("hard"))
    pair = lambda d: d.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    soft = edges.withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")}).join(pair(hard).distinct(), ["a", "b"], "left_anti")
    return hard.unionByName(soft.select("source", "target", "score", "hard"))


def endpoints(edges: DataFrame) -> DataFrame:
    """The nodes that have an edge; others vanish from the merged graph."""
    return edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()


def node_label(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.md\z", "")


#: Nodes that may be laid out.
MOST_NODES = 200_000


def layout(nodes: DataFrame, order: str = "id", pca: str | None = None) -> DataFrame:
    """id, x, y: a given position mapped from [-1, 1] to [0, 1], else phyllotaxis.

    Numbering needs one order over all nodes, so there may be ``MOST_NODES`` of them; more
    are an error. A drawn graph has a few thousand.
    """
    i = (F.row_number().over(Window.orderBy(order)) - 1).alias("i")
    few = nodes.limit(MOST_NODES + 1)
    count = few.agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") <= MOST_NODES, F.col("n")).otherwise(F.raise_error(F.lit("too many nodes to lay out"))).alias("n"))
    rows = few.withColumn("i", i).crossJoin(F.broadcast(count))  # one row
    angle, radius = F.col("i") * GOLDEN_ANGLE, F.sqrt(F.col("i") / F.col("n")) * 0.46
    x, y = 0.5 + F.cos(angle) * radius, 0.5 + F.sin(angle) * radius
    if pca:
        x, y = F.coalesce((F.col(pca)[0] + 1) / 2, x), F.coalesce((F.col(pca)[1] + 1) / 2, y)
    return rows.select("id", x.alias("x"), y.alias("y"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges that touch each node; one from a node to itself counts once."""
    ends = F.array_distinct(F.array("source", "target"))
    return edges.select(F.explode(ends).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def overlay(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Nodes with a query's score, 0 where it has none. ``scores``: file, score."""
    return nodes.join(scores.withColumnRenamed("file", "id"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def node_style(nodes: DataFrame, has_query: bool) -> DataFrame:
    """Adds radius, alpha, accent and labelled to nodes with degree and score. Fixed values."""
    return nodes.withColumns(
        {
            "radius": 4 + F.least(F.lit(7.0), F.col("degree") / 3),
            "alpha": F.greatest(F.lit(0.08), F.col("score")) if has_query else F.lit(1.0),
            "accent": (F.col("score") > 0.55) & F.lit(has_query),
            "labelled": (F.col("score") > 0.2) | F.lit(not has_query),
            "label": node_label(F.col("id")),
        }
    )


def edge_style(edges: DataFrame) -> DataFrame:
    """Links look alike, similar notes by their score. Fixed values."""
    return edges.withColumn("alpha", F.when(F.col("hard"), 0.38).otherwise(F.greatest(F.lit(0.08), F.col("score") * 0.45)))


def nearest(nodes: DataFrame, x: float, y: float, order: str = "id") -> DataFrame:
    """The first node whose disc, widened by 8, has the point."""
    hit = F.hypot(F.col("px") - x, F.col("py") - y) <= F.col("radius") + 8
    return nodes.filter(hit).orderBy(order).limit(1)


def wiki_links(resolved: DataFrame) -> DataFrame:
    """source, target, count from a map of maps per row (``links``)."""
    outer = resolved.select(F.explode("links").alias("source", "targets"))
    return outer.select("source", F.explode("targets").alias("target", "count")).filter(F.col("count") != 0)


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, target, count of the links in each page's HTML."""
    found = T.all_matches(F.coalesce("html", F.lit("")), r'<a\s[^>]*href="([^"]*)"', 1)
    return pages.select("page_id", F.explode(found).alias("target")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("count"))
