"""Queries of search and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import vector as V
from lodestone.operators import graph, search
from lodestone.queries.base import FILE_SQL, FOLDER_SQL, PASSAGES, QUERY, coverage_sql, passages, query_sql, query_vector, read, tokens_sql

#: The vector of row 17 stands for the query's.
ROW = 17


def _r(name: str, as_: str | None = None) -> F.Column:
    return F.round(name, 6).alias(as_ or name)


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = query_vector(spark, sf_dir, 0)
    hits = search.search(passages(spark, sf_dir), q, "", top_k=10, min_score=0.1)
    return hits.select(F.col("passage_id").alias("vec_id"), _r("semantic_score", "score"))


TOPK_SQL = f"""WITH {PASSAGES}, {query_sql(0)}
SELECT passage_id AS vec_id, round(s, 6) AS score FROM (SELECT passage_id, list_dot_product(qv, v) AS s FROM p, q) WHERE s >= 0.1 ORDER BY s DESC, passage_id LIMIT 10"""


def _search(spark: SparkSession, sf_dir: str, **options: object) -> DataFrame:
    hits = search.search(passages(spark, sf_dir), query_vector(spark, sf_dir, ROW), QUERY, **options)
    return hits.select("passage_id", "file", _r("score"), _r("semantic_score"), _r("ranking_score"), _r("filename_boost"), _r("folder_path_boost"))


def _search_sql(top_k: int, min_score: float, window: float, folder: float, where: str = "") -> str:
    wanted = f"list_distinct({tokens_sql(f"'{QUERY}'")})"
    name = f"0.05 * {coverage_sql('w', tokens_sql(FILE_SQL.format('file')))}"
    path = f"{folder} * {coverage_sql('w', tokens_sql(FOLDER_SQL.format('file')))}"
    return f"""WITH {PASSAGES}, {query_sql(ROW)}, w AS (SELECT {wanted} AS w),
s AS (SELECT passage_id, file, list_dot_product(qv, v) AS sem, {name} AS fb, {path} AS pb FROM p, q, w {where}),
t AS (SELECT *, sem + fb + pb AS rk FROM s WHERE sem >= {min_score}),
f AS (SELECT sem - {window} AS floor FROM t ORDER BY rk DESC, passage_id LIMIT 1)
SELECT passage_id, file, round(least(1, rk), 6) AS score, round(sem, 6) AS semantic_score, round(least(1, rk), 6) AS ranking_score,
  round(fb, 6) AS filename_boost, round(pb, 6) AS folder_path_boost FROM t, f WHERE sem >= floor ORDER BY rk DESC, passage_id LIMIT {top_k}"""


def semantic_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, top_k=10, min_score=0.1, score_window=0.9, folder_path_boost=0.06)


def search_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = passages(spark, sf_dir).filter(F.col("passage_id") == ROW).first().file
    return _search(spark, sf_dir, top_k=250, min_score=0.0, score_window=1.0, file=file)


def score_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boost so large that the best-ranked hit isn't the most similar one."""
    return _search(spark, sf_dir, top_k=1000, min_score=0.0, score_window=0.2, folder_path_boost=1.9)


def scores_per_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*map(F.lit, query_vector(spark, sf_dir, ROW)))
    return search.scores_per_note(passages(spark, sf_dir), q).select("file", _r("score"))


NOTE_SCORES_SQL = f"WITH {PASSAGES}, {query_sql(ROW)} SELECT file, round(max(list_dot_product(qv, v)), 6) AS score FROM p, q GROUP BY file"


def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of each passage's others that reach a threshold."""
    rows = passages(spark, sf_dir)
    found = search.block_top_k(rows, rows.select(F.col("passage_id").alias("query_id"), "embedding"), 5, min_score=0.2, exclude_same=True)
    return found.select("query_id", "passage_id", _r("score"), "rank")


BATCH_SQL = f"""WITH {PASSAGES}, s AS (SELECT a.passage_id AS query_id, b.passage_id, list_dot_product(a.v, b.v) AS s FROM p a, p b WHERE a.passage_id <> b.passage_id)
SELECT query_id, passage_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, passage_id)::INTEGER AS rank FROM s WHERE round(s, 12) >= 0.2
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, passage_id) <= 5"""


def quantize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", V.quantize(F.col("embedding")).alias("q"))
    return rows.select("vec_id", F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q"))


_QUANT = "list_transform(embedding, lambda x: greatest(-32767, least(32767, floor(x::DOUBLE * 32767 + 0.5)))::SMALLINT)"
QUANTIZE_SQL = f"SELECT vec_id, array_to_string({_QUANT}, ',') AS q FROM embeddings"


def quantized_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*map(F.lit, query_vector(spark, sf_dir, ROW)))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", V.dot_quantized(q, V.quantize(F.col("embedding"))).alias("score"))
    return rows.select("vec_id", _r("score"))


QUANTIZED_DOT_SQL = f"WITH {query_sql(ROW)} SELECT vec_id, round(list_dot_product(qv, {_QUANT}::DOUBLE[]) / 32767, 6) AS score FROM embeddings, q"


def note_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.centroids(passages(spark, sf_dir))
    return rows.select("file", "node", F.posexplode("embedding").alias("i", "x")).select("file", "node", "i", F.round("x", 6).alias("x"))


CENTROIDS = f"""{PASSAGES}, e AS (SELECT file, passage_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM p),
s AS (SELECT file, i, sum(x) AS x, min(passage_id) AS f FROM e GROUP BY ALL),
n AS (SELECT file, sqrt(sum(x * x)) AS n, min(f) AS node FROM s GROUP BY file)"""
CENTROIDS_SQL = f"WITH {CENTROIDS} SELECT file, node, i::INTEGER AS i, round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS x FROM s JOIN n USING (file)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.knn_edges(graph.centroids(passages(spark, sf_dir)), 5)


def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("source", "target", _r("score"), "rank", "hard")


EDGES = f"""{CENTROIDS}, c AS (SELECT file, node, list(x / CASE WHEN n = 0 THEN 1 ELSE n END ORDER BY i)::FLOAT[]::DOUBLE[] AS v FROM s JOIN n USING (file) GROUP BY ALL),
d AS (SELECT a.file AS source, b.file AS target, a.node, b.node AS other, round(list_dot_product(a.v, b.v), 12) AS score FROM c a, c b WHERE a.node <> b.node),
g AS (SELECT source, target, node, score, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) AS rank FROM d QUALIFY rank <= 5)"""
KNN_SQL = f"WITH {EDGES} SELECT source, target, round(score, 6) AS score, rank::INTEGER AS rank, false AS hard FROM g"


def knn_graph_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.capped(_edges(spark, sf_dir), 200).select("source", "target", _r("score"))


CAPPED_SQL = f"WITH {EDGES} SELECT source, target, round(score, 6) AS score FROM g ORDER BY node, rank LIMIT 200"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note's folder neighbour: 'X/Note n' links to 'X/Note n+1', twice or not at all."""
    files = passages(spark, sf_dir).select("file").distinct()
    number = F.regexp_extract("file", r"Note (\d+)", 1).cast("int")
    target = F.concat(F.regexp_extract("file", r"\A([^/]+)/", 1), F.lit("/Note "), ((number + 1) % 50).cast("string"), F.lit(".md"))
    return files.select(F.col("file").alias("source"), target.alias("target"), (number % 3).alias("count"))


LINKS = """l AS (SELECT file AS source, regexp_extract(file, '^([^/]+)/', 1) || '/Note ' || ((regexp_extract(file, 'Note (\\d+)', 1)::INT + 1) % 50) || '.md' AS target,
  regexp_extract(file, 'Note (\\d+)', 1)::INT % 3 AS count FROM (SELECT DISTINCT file FROM p)),
h AS (SELECT source, target, 1.0::DOUBLE AS score, true AS hard FROM l WHERE count <> 0),
mg AS (SELECT * FROM h UNION ALL SELECT source, target, score, false FROM g WHERE NOT EXISTS (SELECT 1 FROM h
  WHERE least(h.source, h.target) = least(g.source, g.target) AND greatest(h.source, h.target) = greatest(g.source, g.target)))"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_links(_edges(spark, sf_dir), _links(spark, sf_dir))


def merged_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("source", "target", _r("score"), "hard")


MERGED_SQL = f"WITH {EDGES}, {LINKS} SELECT source, target, round(score, 6) AS score, hard FROM mg"


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.endpoints(_merged(spark, sf_dir)).select("id", graph.node_label(F.col("id")).alias("label"))


NODES_SQL = f"WITH {EDGES}, {LINKS} SELECT id, regexp_replace(string_split(id, '/')[-1], '(?i)\\.md$', '') AS label FROM (SELECT source AS id FROM mg UNION SELECT target FROM mg)"


def graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = passages(spark, sf_dir).groupBy(F.col("file").alias("id")).agg(F.min("passage_id").alias("node"))
    return graph.layout(nodes, "node").select("id", _r("x"), _r("y"))


LAYOUT_SQL = f"""WITH {PASSAGES}, n AS (SELECT file AS id, row_number() OVER (ORDER BY min(passage_id)) - 1 AS i, count(*) OVER () AS n FROM p GROUP BY file)
SELECT id, round(0.5 + cos(i * (pi() * (3 - sqrt(5)))) * sqrt(i / n) * 0.46, 6) AS x, round(0.5 + sin(i * (pi() * (3 - sqrt(5)))) * sqrt(i / n) * 0.46, 6) AS y FROM n"""


def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_merged(spark, sf_dir))


DEGREE_SQL = f"""WITH {EDGES}, {LINKS} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM mg UNION ALL SELECT target FROM mg WHERE target <> source) GROUP BY id"""


def graph_score_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all notes over all nodes, and one that no score knows, with their style."""
    q = F.array(*map(F.lit, query_vector(spark, sf_dir, ROW)))
    rows = passages(spark, sf_dir)
    scores = search.scores_per_note(rows, q)
    nodes = rows.groupBy(F.col("file").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    nodes = nodes.unionByName(spark.range(1).select(F.lit("Apart/Lone.md").alias("id"), F.lit(2).cast("long").alias("degree")))
    styled = graph.node_style(graph.overlay(nodes, scores), True)
    return styled.select("id", _r("score"), _r("radius"), _r("alpha"), "accent", "labelled", "label")


OVERLAY_SQL = f"""WITH {PASSAGES}, {query_sql(ROW)}, s AS (SELECT file, max(list_dot_product(qv, v)) AS s FROM p, q GROUP BY file),
n AS (SELECT file AS id, count(*) AS degree FROM p GROUP BY file UNION ALL SELECT 'Apart/Lone.md', 2)
SELECT id, round(coalesce(s, 0), 6) AS score, round(4 + least(7, degree / 3), 6) AS radius, round(greatest(0.08, coalesce(s, 0)), 6) AS alpha,
  coalesce(s, 0) > 0.55 AS accent, coalesce(s, 0) > 0.2 AS labelled, regexp_replace(string_split(id, '/')[-1], '(?i)\\.md$', '') AS label FROM n LEFT JOIN s ON file = id"""


def edge_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_style(_merged(spark, sf_dir)).select("source", "target", "hard", _r("alpha"))


EDGE_STYLE_SQL = f"WITH {EDGES}, {LINKS} SELECT source, target, hard, round(CASE WHEN hard THEN 0.38 ELSE greatest(0.08, 0.45 * score) END, 6) AS alpha FROM mg"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.page_links(read(spark, sf_dir, "pages"))


PAGE_LINKS_SQL = """SELECT page_id, target, count(*) AS count FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS target FROM pages) GROUP BY ALL"""

def wiki_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from a map of maps per page; those that count nothing go."""
    targets = F.create_map(F.lit("a.md"), (F.col("page_id") % 3).cast("int"), F.lit("b.md"), F.lit(2))
    rows = read(spark, sf_dir, "pages").select(F.create_map(F.col("page_id").cast("string"), targets).alias("links"))
    return graph.wiki_links(rows)


WIKI_SQL = """SELECT page_id::VARCHAR AS source, 'a.md' AS target, (page_id % 3)::INTEGER AS count FROM pages WHERE page_id % 3 <> 0
UNION ALL SELECT page_id::VARCHAR, 'b.md', 2 FROM pages"""


def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node under a pointer in the middle of a drawing of 300 by 300."""
    nodes = graph_layout(spark, sf_dir).select("id", (F.col("x") * 300).alias("px"), (F.col("y") * 300).alias("py"), F.lit(5.0).alias("radius"))
    return graph.nearest(nodes, 150.0, 150.0).select("id")


NEAREST_SQL = f"SELECT id FROM ({LAYOUT_SQL}) WHERE sqrt((x * 300 - 150) ** 2 + (y * 300 - 150) ** 2) <= 13 ORDER BY id LIMIT 1"

QUERIES = {
    "wiki_links": (wiki_links, WIKI_SQL),
    "nearest_node": (nearest_node, NEAREST_SQL),
    "semantic_topk": (semantic_topk, TOPK_SQL),
    "semantic_search_ranked": (semantic_search_ranked, _search_sql(10, 0.1, 0.9, 0.06)),
    "search_in_file": (search_in_file, _search_sql(250, 0.0, 1.0, 0.0, f"WHERE file = (SELECT file FROM p WHERE passage_id = {ROW})")),
    "score_window": (score_window, _search_sql(1000, 0.0, 0.2, 1.9)),
    "scores_per_note": (scores_per_note, NOTE_SCORES_SQL),
    "batch_search": (batch_search, BATCH_SQL),
    "quantize_vectors": (quantize_vectors, QUANTIZE_SQL),
    "quantized_dot": (quantized_dot, QUANTIZED_DOT_SQL),
    "note_centroids": (note_centroids, CENTROIDS_SQL),
    "knn_graph": (knn_graph, KNN_SQL),
    "knn_graph_capped": (knn_graph_capped, CAPPED_SQL),
    "merged_graph": (merged_graph, MERGED_SQL),
    "graph_nodes": (graph_nodes, NODES_SQL),
    "graph_layout": (graph_layout, LAYOUT_SQL),
    "node_degree": (node_degree, DEGREE_SQL),
    "graph_score_overlay": (graph_score_overlay, OVERLAY_SQL),
    "edge_style": (edge_style, EDGE_STYLE_SQL),
    "page_links": (page_links, PAGE_LINKS_SQL),
}
