"""Tables as notes and passages, in both dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.shipping import ship

QUERY = "Parenting agencies note"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as passages: fifty notes in each of three folders."""
    rows = read(spark, sf_dir, "embeddings")
    folder = F.element_at(F.array(*map(F.lit, ("Agency", "Parenting", "Freedom"))), F.col("label") % 3 + 1)
    file = F.concat(folder, F.lit("/Note "), (F.col("vec_id") % 50).cast("string"), F.lit(".md"))
    return rows.select(F.col("vec_id").alias("passage_id"), file.alias("file"), "embedding", "label")


PASSAGES = """p AS (SELECT vec_id AS passage_id, (['Agency', 'Parenting', 'Freedom'])[label % 3 + 1] || '/Note ' || (vec_id % 50) || '.md' AS file,
  embedding::DOUBLE[] AS v, label FROM embeddings)"""


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """The vector of one row, as a search's caller would give it."""
    return [float(x) for x in read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first().embedding]


def query_sql(vec_id: int) -> str:
    return f"q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = {vec_id})"


def tokens_sql(x: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 2)"
    return f"list_transform({kept}, lambda t: regexp_replace(regexp_replace(regexp_replace(t, 'ies$', 'y'), 'ing$', ''), 's$', ''))"


def coverage_sql(wanted: str, having: str) -> str:
    return f"(len(list_filter({wanted}, lambda t: list_contains({having}, t))) / len({wanted}))"


FILE_SQL = "regexp_replace(string_split({0}, '/')[-1], '(?i)\\.(md|txt|markdown)$', '')"
FOLDER_SQL = "array_to_string(string_split({0}, '/')[:-2], '/')"


def markdown(text: Column, doc_id: Column) -> Column:
    """Documents as Markdown: paragraphs, headings, front matter in every fifth."""
    body = F.replace(F.replace(text, F.lit("\n"), F.lit("\n\n# Part\n\n")), F.lit(". "), F.lit(".\n\n"))
    return F.concat(F.when(doc_id % 5 == 0, "---\nk: v\n---\n").otherwise(""), body)


MARKDOWN = """m AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN '---' || chr(10) || 'k: v' || chr(10) || '---' || chr(10) ELSE '' END
  || replace(replace(text, chr(10), chr(10) || chr(10) || '# Part' || chr(10) || chr(10)), '. ', '.' || chr(10) || chr(10)) AS content FROM documents)"""
