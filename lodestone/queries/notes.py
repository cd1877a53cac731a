"""Queries of phrase, highlight, result, index and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators import embed, highlight, index, phrases, results, search
from lodestone.queries.base import FILE_SQL, PASSAGES, QUERY, coverage_sql, passages, query_sql, query_vector, read, tokens_sql
from lodestone.queries.texts import _LIST, _SENTENCES, _SNIPPETS, _WORD_SQL, STOPS, lemma_sql
from lodestone.sources import index_store
from lodestone.sources import notes as sources
from lodestone.streaming import updates

ROW = 17


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.sentences(F.col("text"), 24)).alias("sentence_id", "sentence"))
    return rows


def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one to three words of each sentence that pass the stop-word rules."""
    words = T.sentence_words(F.col("sentence"))
    runs = _sentences(spark, sf_dir).select("item_id", "sentence_id", F.explode(phrases.ngrams(words)).alias("g"))
    kept = runs.filter(phrases.passes_stop_rules(F.col("g.run"), F.col("g.words")))
    text = F.array_join(F.transform("g.run", lambda w: w["text"]), " ")
    return kept.select("item_id", "sentence_id", F.col("g.start").alias("start"), F.col("g.words").alias("words"), text.alias("phrase")).filter(F.length("phrase").between(3, 60))


_BENCH_SENTENCES = _SENTENCES.replace("doc_id", "item_id").replace("FROM documents", "FROM benchmark")
_BENCH_SAMPLED = f"""{_BENCH_SENTENCES}, b AS (SELECT item_id, CASE WHEN len(s) <= 24 THEN s ELSE list_transform(range(24), lambda i: s[floor(i * (len(s) - 1) / 23 + 0.5)::INT + 1]) END AS s FROM a),
z AS (SELECT item_id, unnest(s) AS sentence, unnest(range(len(s)))::INTEGER AS sentence_id FROM b)"""
_NGRAMS = f"""{_BENCH_SAMPLED}, w AS (SELECT item_id, sentence_id, regexp_extract_all(sentence, '{_WORD_SQL}') AS w FROM z),
u AS (SELECT item_id, sentence_id, w, unnest(range(len(w)))::INTEGER AS start FROM w), n AS (SELECT *, unnest([1, 2, 3]) AS words FROM u),
r AS (SELECT item_id, sentence_id, start, words, w[start + 1 : start + words] AS run FROM n WHERE start + words <= len(w)),
m AS (SELECT *, list_transform(run, lambda x: {lemma_sql('x')}) AS lem, array_to_string(list_transform(run, lambda x: regexp_replace(x, '[.,!?]+$', '')), ' ') AS phrase FROM r),
st AS (SELECT *, list_transform(lem, lambda x: x IN ({_LIST(STOPS)})) AS stop FROM m),
ng AS (SELECT item_id, sentence_id, start, words::INTEGER AS words, phrase FROM st WHERE (NOT stop[1] OR (words > 1 AND lem[1] IN ('a', 'an', 'the'))) AND NOT stop[-1]
  AND len(list_filter(stop, lambda x: NOT x)) > 0 AND length(phrase) BETWEEN 3 AND 60)"""
NGRAMS_SQL = f"WITH {_NGRAMS} SELECT * FROM ng"


def _qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n-grams with a quality that is a function of their length, instead of tags."""
    quality = F.round((F.length("phrase") % 7) / 100 + F.when(F.col("words") == 2, phrases.TWO).when(F.col("words") == 3, phrases.THREE).otherwise(0.0), 6)
    return ngrams(spark, sf_dir).withColumns({"quality": quality, "pos": F.col("start") * 4 + F.col("words")})


_QUALITY = "round(length(phrase) % 7 / 100 + CASE words WHEN 2 THEN 0.05 WHEN 3 THEN 0.03 ELSE 0 END, 6)"
_BEST = f"""{_NGRAMS}, qg AS (SELECT *, {_QUALITY} AS quality, start * 4 + words AS pos FROM ng),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id, sentence_id, words > 1 ORDER BY quality DESC, words DESC, pos) AS r FROM qg),
best AS (SELECT *, (row_number() OVER (PARTITION BY item_id, sentence_id ORDER BY (words > 1) DESC, r) - 1)::INTEGER AS level FROM rk WHERE r <= CASE WHEN words > 1 THEN 3 ELSE 5 END)"""


def candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = phrases.best_of_sentence(_qualified(spark, sf_dir), ["item_id", "sentence_id"])
    return best.select("item_id", "sentence_id", "start", "words", "phrase", "level")


TOPK_SQL = f"WITH {_BEST} SELECT item_id, sentence_id, start, words, phrase, level FROM best"


def candidate_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = phrases.best_of_sentence(_qualified(spark, sf_dir), ["item_id", "sentence_id"])
    return phrases.interleave(best, ["item_id"], F.lit(24)).select("item_id", "sentence_id", "phrase", "turn")


_TURNS = f"{_BEST}, tn AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY level, sentence_id)::INTEGER AS turn FROM best QUALIFY turn <= 24)"
INTERLEAVE_SQL = f"WITH {_TURNS} SELECT item_id, sentence_id, phrase, turn FROM tn"


def dedupe_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = phrases.best_of_sentence(_qualified(spark, sf_dir), ["item_id", "sentence_id"])
    turned = phrases.interleave(best, ["item_id"], F.lit(24)).withColumnRenamed("item_id", "passage_id").withColumn("field", F.lit("body"))
    return phrases.first_of_each(turned.drop("pos")).select(F.col("passage_id").alias("item_id"), "phrase", "pos")


DEDUPE_SQL = f"""WITH {_TURNS}, d AS (SELECT * FROM tn QUALIFY row_number() OVER (PARTITION BY item_id, lower(phrase) ORDER BY turn) = 1)
SELECT item_id, phrase, (row_number() OVER (PARTITION BY item_id ORDER BY turn) - 1)::INTEGER AS pos FROM d"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("passage_id"), F.concat(F.lit("Topics/Item "), F.col("item_id").cast("string"), F.lit(".md")).alias("file"), F.lit("On the whole").alias("heading"), "text")


def phrase_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the built-in tagger."""
    return phrases.candidates(_items(spark, sf_dir)).withColumn("quality", F.round("quality", 6))


# Fixed values for SQL: the tagger's words, and nouns that are too general alone.
_VERBS = _LIST("is are was be do does go make take teach read write give find keep raise require oppose".split())
_GENERIC = _LIST("answer concept example fact idea kind part point question section thing thought type way".split())
_TAG = f"""CASE WHEN lower(x) IN ('oh', 'hello', 'wow', 'please', 'thanks', 'yes', 'ok') THEN 'e' WHEN lower(x) IN ({_LIST(STOPS)}) THEN 'f'
  WHEN lower(x) IN ({_VERBS}) OR ({lemma_sql('x')}) IN ({_VERBS}) OR ({lemma_sql('x')}) || 'e' IN ({_VERBS}) THEN 'v'
  WHEN regexp_matches(lower(x), '(ous|ful|ive|able|ible|al|ic|less|ish)$') THEN 'a' WHEN lower(x) LIKE '%ly' THEN 'r' ELSE 'n' END"""
_CANDIDATES = f"""{_BENCH_SAMPLED}, fz AS (SELECT item_id, 'body' AS field, sentence_id, sentence FROM z
  UNION ALL SELECT item_id, 'filename', 0, 'Item ' || item_id FROM benchmark UNION ALL SELECT item_id, 'heading', 0, 'On the whole' FROM benchmark),
fw AS (SELECT item_id, field, sentence_id, regexp_extract_all(sentence, '{_WORD_SQL}') AS w FROM fz),
fx AS (SELECT *, list_transform(w, lambda x: regexp_replace(x, '[.,!?]+$', '')) AS t, list_transform(w, lambda x: {lemma_sql('x')}) AS l FROM fw),
ft AS (SELECT *, list_transform(t, lambda x: {_TAG}) AS g, list_transform(l, lambda x: x IN ({_LIST(STOPS)})) AS s FROM fx),
fs AS (SELECT *, unnest(range(len(w)))::INTEGER AS start FROM ft), fn AS (SELECT *, unnest([1, 2, 3])::INTEGER AS words FROM fs),
fr AS (SELECT item_id, field, sentence_id, start, words, array_to_string(t[start + 1 : start + words], ' ') AS phrase, l[start + 1 : start + words] AS l, g[start + 1 : start + words] AS g, s[start + 1 : start + words] AS s
  FROM fn WHERE start + words <= len(w)),
fh AS (SELECT *, list_contains(g, 'n') AS noun, list_contains(g, 'v') AS verb, list_contains(g, 'e') AS expr, list_contains(g, 'a') AS adj, list_position(g, 'n') AS pn, list_position(g, 'v') AS pv FROM fr),
fq AS (SELECT *, CASE WHEN noun THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN pv > 0 AND pn > 0 AND pv < pn THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN noun AND adj THEN 0.06::DOUBLE ELSE 0 END
  + CASE WHEN expr THEN 0.07::DOUBLE ELSE 0 END + CASE words WHEN 2 THEN 0.05::DOUBLE WHEN 3 THEN 0.03::DOUBLE ELSE 0 END AS quality FROM fh
  WHERE (NOT s[1] OR (words > 1 AND l[1] IN ('a', 'an', 'the'))) AND NOT s[-1] AND len(list_filter(s, lambda x: NOT x)) > 0 AND length(phrase) BETWEEN 3 AND 60
  AND CASE WHEN words = 1 THEN (noun OR verb OR expr) AND l[1] NOT IN ({_GENERIC}) ELSE noun OR expr END),
fk AS (SELECT *, row_number() OVER (PARTITION BY item_id, field, sentence_id, words > 1 ORDER BY quality DESC, words DESC, start * 4 + words) AS r FROM fq),
fl AS (SELECT *, row_number() OVER (PARTITION BY item_id, field, sentence_id ORDER BY (words > 1) DESC, r) AS level FROM fk WHERE r <= CASE WHEN words > 1 THEN 3 ELSE 5 END),
fi AS (SELECT *, row_number() OVER (PARTITION BY item_id, field ORDER BY level, sentence_id) AS turn FROM fl QUALIFY turn <= CASE field WHEN 'body' THEN 24 ELSE 8 END),
fd AS (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY item_id, field, lower(phrase) ORDER BY turn) = 1)"""
CANDIDATES_SQL = f"""WITH {_CANDIDATES} SELECT item_id AS passage_id, field, sentence_id::INTEGER AS sentence_id, phrase, start, start + words - 1 AS "end", words, noun AS has_noun, verb AS has_verb, expr AS has_expression,
  adj AND NOT noun AND NOT verb AS adjective_only, round(quality, 6) AS quality,
  (row_number() OVER (PARTITION BY item_id ORDER BY CASE field WHEN 'filename' THEN 0 WHEN 'heading' THEN 1 ELSE 2 END, turn) - 1)::INTEGER AS pos FROM fd"""


def phrase_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct phrases embedded once, as 16-bit vectors."""
    made = embed.embed_phrases(phrases.candidates(_items(spark, sf_dir)))
    return made.select("phrase_key", F.size("vector").alias("n"))


VECTORS_SQL = f"WITH {_CANDIDATES} SELECT DISTINCT lower(trim(phrase)) AS phrase_key, 64 AS n FROM fd"


def _candidates_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without tags, each with the vector of a row of ``embeddings``."""
    rows = _qualified(spark, sf_dir).withColumns({"passage_id": F.col("item_id"), "end": F.col("start") + F.col("words") - 1, "vec_id": (F.col("item_id") * 31 + F.col("pos") + F.col("sentence_id") * 7) % 500})
    flags = {"has_noun": F.col("words") > 1, "has_expression": F.lit(False), "adjective_only": F.col("pos") % 5 == 0, "field": F.element_at(F.array(*map(F.lit, ("filename", "heading", "body"))), F.col("sentence_id") % 3 + 1)}
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", V.quantize(F.col("embedding")).alias("vector"))
    return rows.withColumns(flags).join(vectors, "vec_id")


HIGHLIGHT_QUERY = "the anthat erwhly"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*map(F.lit, query_vector(spark, sf_dir, ROW)))
    return highlight.score_candidates(_candidates_with_vectors(spark, sf_dir), F.lit(HIGHLIGHT_QUERY), q)


def highlight_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("fit", highlight.accepted(0.3, 0.2))
    return rows.select("item_id", "sentence_id", "start", "words", "anchors", F.round("confidence", 6).alias("confidence"), F.round("rank_score", 6).alias("rank_score"), "fit")


_DIRECT = "list_dot_product(qv, list_transform(embedding, lambda x: greatest(-32767, least(32767, floor(x::DOUBLE * 32767 + 0.5))))::DOUBLE[]) / 32767"
_LEMMAS = f"list_distinct(list_transform(regexp_extract_all(phrase, '{_WORD_SQL}'), lambda x: {lemma_sql('x')}))"
_HIGHLIGHTED = f"""{_NGRAMS}, {query_sql(ROW)}, qg AS (SELECT *, {_QUALITY} AS quality, start * 4 + words AS pos FROM ng),
v AS (SELECT qg.*, {_DIRECT} AS direct, len(list_filter({_LEMMAS}, lambda x: x IN ('anthat', 'erwhly'))) AS anchors FROM qg JOIN embeddings ON vec_id = (item_id * 31 + pos + sentence_id * 7) % 500, q),
s AS (SELECT *, direct + 0.025 * anchors AS confidence, CASE WHEN words = 1 THEN 0.3 ELSE 0.2 END AS bar FROM v),
hl AS (SELECT *, confidence + 0.05 * anchors + CASE WHEN words > 1 THEN 0.02 ELSE 0 END + 0.012 * words + quality AS rank_score,
  NOT (pos % 5 = 0 AND anchors = 0 AND direct < bar + 0.06) AND (confidence >= bar OR (anchors > 0 AND direct >= bar - 0.1) OR (words > 1 AND direct >= bar - 0.05)) AS fit FROM s)"""
HIGHLIGHT_SQL = f"""WITH {_HIGHLIGHTED} SELECT item_id, sentence_id, start, words, anchors::INTEGER AS anchors, round(confidence, 6) AS confidence, round(rank_score, 6) AS rank_score, fit FROM hl"""


def highlight_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = highlight.select_highlights(_scored(spark, sf_dir), ["passage_id"], single_min=0.3, phrase_min=0.2)
    return chosen.select("passage_id", "field", F.posexplode("highlights").alias("i", "h")).select("passage_id", "field", "i", "h.phrase", F.round("h.score", 6).alias("score"))


# The best, then the best that doesn't meet it, then the best that meets neither.
_MEETS = "{0}.sentence_id = {1}.sentence_id AND {0}.start < {1}.start + {1}.words AND {1}.start < {0}.start + {0}.words"
SELECT_SQL = f"""WITH {_HIGHLIGHTED}, it AS (SELECT item_id AS p, (['filename', 'heading', 'body'])[sentence_id % 3 + 1] AS field, sentence_id, start, words, phrase, pos, confidence, rank_score FROM hl WHERE fit),
k AS (SELECT *, row_number() OVER (PARTITION BY p, field ORDER BY rank_score DESC, pos, sentence_id, start) AS r FROM it),
c1 AS (SELECT * FROM k WHERE r = 1),
c2 AS (SELECT k.* FROM k JOIN c1 USING (p, field) WHERE k.r > 1 AND NOT ({_MEETS.format('k', 'c1')}) QUALIFY row_number() OVER (PARTITION BY p, field ORDER BY k.r) = 1),
c3 AS (SELECT k.* FROM k JOIN c1 USING (p, field) JOIN c2 USING (p, field) WHERE field = 'body' AND k.r > c2.r AND NOT ({_MEETS.format('k', 'c1')}) AND NOT ({_MEETS.format('k', 'c2')})
  QUALIFY row_number() OVER (PARTITION BY p, field ORDER BY k.r) = 1)
SELECT p AS passage_id, field, i::INTEGER AS i, phrase, round(confidence, 6) AS score FROM (SELECT *, 0 AS i FROM c1 UNION ALL SELECT *, 1 FROM c2 UNION ALL SELECT *, 2 FROM c3)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the texts of documents, and phrases as highlights."""
    hits = search.search(passages(spark, sf_dir), query_vector(spark, sf_dir, ROW), QUERY, top_k=60, min_score=0.0)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), F.regexp_replace("text", r"\*", "").alias("text"))
    wide = search.fetch(hits, docs)
    item = lambda c: F.struct(c.alias("phrase"), F.lit(0.5).alias("score"))
    word = lambda n: F.lower(F.regexp_extract("text", r"\A([\p{L}]+) ([\p{L}]+)", n))
    return wide.withColumns({
        "heading": F.lit("H"), "line_start": F.lit(0), "line_end": F.lit(3), "filename_highlights": F.array(item(F.lit("Note"))),
        "heading_highlights": F.array(item(word(1))), "semantic_highlights": F.array(item(F.lit("onth")), item(F.lit("the and"))),
    })


# The sixty hits with their snippets, in rank order.
_HITS_SQL = f"""{_SNIPPETS}, {PASSAGES}, {query_sql(ROW)}, ws AS (SELECT list_distinct({tokens_sql(f"'{QUERY}'")}) AS w),
sc AS (SELECT passage_id, file, list_dot_product(qv, v) AS sem, 0.05 * {coverage_sql('w', tokens_sql(FILE_SQL.format('file')))} AS fb FROM p, q, ws),
th AS (SELECT *, sem + fb AS rk FROM sc WHERE sem >= 0), fl AS (SELECT sem - 1 AS floor FROM th ORDER BY rk DESC, passage_id LIMIT 1),
hs AS (SELECT passage_id, file, rk, least(1, rk) AS score FROM th, fl WHERE sem >= floor ORDER BY rk DESC, passage_id LIMIT 60),
ht AS (SELECT hs.*, snippet, lower(regexp_extract(replace(text, '*', ''), '^([\\p{{L}}]+) ([\\p{{L}}]+)', 1)) AS word,
  row_number() OVER (ORDER BY score DESC, passage_id) AS r FROM hs JOIN documents ON doc_id = passage_id JOIN sn USING (doc_id))"""


def group_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = results.group_by_note(_hits(spark, sf_dir), "the thing that was from anth", 20)
    first = F.element_at("snippets", 1)
    return cards.select("file", F.round("score", 6).alias("score"), F.round("semantic_score", 6).alias("semantic_score"), F.size("snippets").alias("snippets"), F.md5(first["text"]).alias("first"), F.array_join("filename_highlights", ",").alias("names"))


GROUP_SQL = f"""WITH {_HITS_SQL}, d AS (SELECT *, snippet <> '' AND row_number() OVER (PARTITION BY file, snippet ORDER BY r) = 1 AS fresh FROM ht),
cd AS (SELECT file, min(r) AS r, arg_min(score, r) AS score, count(*) FILTER (fresh) AS n, arg_min(snippet, r) FILTER (fresh) AS first FROM d GROUP BY file)
SELECT file, round(score, 6) AS score, round(score, 6) AS semantic_score, least(n, 3)::INTEGER AS snippets, md5(first) AS first, 'Note' AS names FROM cd WHERE n > 0 ORDER BY r LIMIT 20"""


def passage_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results.by_passage(_hits(spark, sf_dir), "the thing that was from anth", 25)
    return rows.select("passage_id", "file", F.round("score", 6).alias("score"), F.md5("snippet").alias("hash"), F.size("semantic_highlights").alias("n"))


PASSAGE_SQL = f"WITH {_HITS_SQL} SELECT passage_id, file, round(score, 6) AS score, md5(snippet) AS hash, 2 AS n FROM ht WHERE r <= 25 AND snippet <> ''"


def phrase_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.phrase_pool(_hits(spark, sf_dir))


POOL_SQL = f"WITH {_HITS_SQL} SELECT 'Note' AS phrase UNION SELECT unnest(['onth', 'the and']) UNION SELECT word FROM ht WHERE word NOT IN ('', 'note')"


def _notes(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """Two states of a vault: of every ten notes one is deleted, one is new, one changes
    and one is only touched."""
    docs, kind = read(spark, sf_dir, "documents"), F.col("doc_id") % 10
    kept = docs.filter(kind != (0 if later else 1))
    mtime = F.when((kind == 2) | (kind == 3), 2).otherwise(1) if later else F.lit(1)
    content = F.when(kind == 2, F.concat("text", F.lit(" more"))).otherwise(F.col("text")) if later else F.col("text")
    return sources.notes_of_table(kept, F.concat(F.lit("n/"), F.col("doc_id").cast("string"), F.lit(".md")), mtime, content)


def _index(notes: DataFrame) -> DataFrame:
    none = F.array().cast(f"array<{index_store.CANDIDATE}>")
    return notes.select(
        "file", F.lit(0).alias("chunk_no"), F.lit("").alias("heading"), F.col("content").alias("text"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), "mtime",
        T.fingerprint(F.col("content")).alias("content_hash"), F.lit(index_store.HIGHLIGHT_VERSION).alias("highlight_version"),
        F.array(F.lit(1.0).cast("float")).alias("embedding"), none.alias("candidates"),
    )


def classify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.classify(_notes(spark, sf_dir, True), _index(_notes(spark, sf_dir, False))).select("file", "action")


CLASSIFY_SQL = "SELECT 'n/' || doc_id || '.md' AS file, CASE doc_id % 10 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'UPSERT' WHEN 2 THEN 'UPSERT' WHEN 3 THEN 'TOUCH' ELSE 'SKIP' END AS action FROM documents"


def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after an update: each file's time, fingerprint, passages and text, and
    whether its vectors are new ones (of 64 components) or the old one (of one)."""
    before, notes = _index(_notes(spark, sf_dir, False)), _notes(spark, sf_dir, True)
    after = index.apply_changes(before, notes, index.classify(notes, before))
    first = F.min_by(F.substring("text", 1, 20), "chunk_no")
    return after.groupBy("file").agg(
        F.max("mtime").alias("mtime"), F.max(F.substring_index("content_hash", ":", 1)).cast("long").alias("units"), F.md5(first).alias("first"), F.max(F.size("embedding")).alias("dimension")
    )


APPLY_SQL = """SELECT 'n/' || doc_id || '.md' AS file, CASE WHEN doc_id % 10 IN (2, 3) THEN 2 ELSE 1 END::BIGINT AS mtime, (length(text) + CASE WHEN doc_id % 10 = 2 THEN 5 ELSE 0 END)::BIGINT AS units,
  md5(left(text || CASE WHEN doc_id % 10 = 2 THEN ' more' ELSE '' END, 20)) AS first, CASE WHEN doc_id % 10 IN (1, 2) THEN 64 ELSE 1 END AS dimension FROM documents WHERE doc_id % 10 <> 0 AND trim(text) <> ''"""


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _index(_notes(spark, sf_dir, False))
    return index.status(before, index.classify(_notes(spark, sf_dir, True), before))


STATUS_SQL = """SELECT count(*) FILTER (doc_id % 10 <> 1) AS files, count(*) FILTER (doc_id % 10 <> 1) AS passages, 0::BIGINT AS phrases,
  count(*) FILTER (doc_id % 10 <> 0) AS vault_files, count(*) FILTER (doc_id % 10 < 4) AS stale_files, count(*) FILTER (doc_id % 10 >= 4) AS processed_files FROM documents"""


def phrase_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of an index whose passages are sentences; a vector is a phrase's place."""
    one = F.struct(
        F.col("phrase"), F.lit("body"), F.lit(0), F.col("start"), F.col("start"), F.col("words"), F.lit(True), F.lit(False), F.lit(False), F.lit(False), F.lit(0.1), F.array(F.col("pos").cast("smallint"))
    ).cast(index_store.CANDIDATE)
    grouped = _qualified(spark, sf_dir).groupBy("item_id", "sentence_id").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("c")))).alias("l"))
    rows = grouped.select(F.lpad(F.col("item_id").cast("string"), 8, "0").alias("file"), F.col("sentence_id").alias("chunk_no"), F.transform("l", lambda x: x["c"]).alias("candidates"))
    return embed.phrase_dictionary(rows).select("phrase_key", F.col("vector")[0].cast("int").alias("place"))


DICTIONARY_SQL = f"""WITH {_NGRAMS}, g AS (SELECT lower(trim(phrase)) AS phrase_key, item_id, sentence_id, start * 4 + words AS pos FROM ng)
SELECT phrase_key, arg_max(pos, (item_id, sentence_id, pos))::INTEGER AS place FROM g GROUP BY phrase_key"""


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passages(spark, sf_dir)
    none = F.array().cast(f"array<{index_store.CANDIDATE}>")
    made = rows.select(
        "file", F.lit("").alias("heading"), F.lit("t").alias("text"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit(1).cast("long").alias("mtime"),
        F.lit("h").alias("content_hash"), F.lit(1).alias("highlight_version"), "embedding", none.alias("candidates"),
    )
    return index.statistics(made)


_META = """'{"file":"' || file || '","heading":"","text":"t","line_start":0,"line_end":0,"mtime":1,"content_hash":"h","highlight_version":1,"candidates":[]}'"""
STATS_SQL = f"""SELECT count(DISTINCT file) AS files, count(*) AS passages, 0::BIGINT AS phrases, sum(len(embedding) * 4)::BIGINT AS vector_bytes, sum(strlen({_META}) + 1)::BIGINT AS meta_bytes
FROM (SELECT (['Agency', 'Parenting', 'Freedom'])[label % 3 + 1] || '/Note ' || (vec_id % 50) || '.md' AS file, embedding FROM embeddings)"""


def index_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some passages have a short vector, some a candidate with one, some no candidates."""
    vector = V.quantize(F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    one = F.struct(F.lit("a phrase"), F.lit("body"), F.lit(0), F.lit(0), F.lit(1), F.lit(2), F.lit(True), F.lit(False), F.lit(False), F.lit(False), F.lit(0.1), vector).cast(index_store.CANDIDATE)
    candidates = F.when(F.col("vec_id") % 3 > 0, F.array(one)).when(F.col("vec_id") % 3 == 0, F.array().cast(f"array<{index_store.CANDIDATE}>"))
    short = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    rows = read(spark, sf_dir, "embeddings").select(short.alias("embedding"), candidates.alias("candidates"))
    return index_store.validate(rows, 64)


VALIDATE_SQL = "SELECT count(*) AS passages, count(*) FILTER (vec_id % 9 = 0) AS bad_vectors, count(*) FILTER (vec_id % 3 > 0 AND vec_id % 7 = 0) AS bad_candidates FROM embeddings"


def health_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    phase = F.element_at(F.array(*map(F.lit, ("ready", "indexing", "starting", "error", "offline"))), (e % 5 + 1).cast("int"))
    h = index.health(phase, e % 7 > 0, e % 3 > 0, e % 11 == 0, e % 4, e % 30, e % 120, F.lit(100))
    return read(spark, sf_dir, "events").select("event_id", h["status"].alias("status"), h["stopped"].alias("stopped"), F.round(h["progress"], 6).alias("progress"))


HEALTH_SQL = """WITH e AS (SELECT event_id AS e, event_id % 3 > 0 AND event_id % 11 = 0 AS indexing, event_id % 5 IN (1, 2) AS phase FROM events),
s AS (SELECT e, e % 5 = 0 AND NOT indexing AND (e % 3 = 0 OR e % 4 = 0) AS healthy, indexing OR phase AS working, e % 3 = 0 AND (indexing OR phase) AND e % 30 > 15 AS stopped FROM e)
SELECT e AS event_id, CASE WHEN healthy THEN 'healthy' WHEN working AND NOT stopped THEN 'working' WHEN e % 7 > 0 THEN 'error' ELSE 'disabled' END AS status, stopped,
  CASE WHEN working AND NOT stopped THEN least(100.0, e % 120)::DOUBLE END AS progress FROM s"""


def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.debounce(read(spark, sf_dir, "events"), "30 minutes", "user_id")


DEBOUNCE_SQL = """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS events FROM s GROUP BY user_id, s"""


def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.latest_wins(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "value")


LATEST_SQL = "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id, count(*) AS requests FROM events GROUP BY user_id"


def stale_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.stale(read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


STALE_SQL = "SELECT user_id, event_id, event_id < max(event_id) OVER (PARTITION BY user_id) AS stale FROM events"


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(F.col("p_name").alias("relative"), F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))
    target = parts.filter("key % 3 > 0").select("relative", F.when(F.col("key") % 2 == 0, F.col("size") + 100).otherwise(F.col("size")).alias("size"))
    return sources.missing_files(parts, target).select("relative", "size", "key")


MISSING_SQL = """SELECT p_name AS relative, p_size AS size, p_partkey AS key FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey % 3 > 0
  AND b.p_name = a.p_name AND a.p_size = CASE WHEN b.p_partkey % 2 = 0 THEN b.p_size + 100 ELSE b.p_size END)"""


def hashing_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _items(spark, sf_dir).select("passage_id", embed.embedder("query")("text").alias("v"))
    return made.select("passage_id", F.size("v").alias("n"), F.round(F.sqrt(V.dot(F.col("v"), F.col("v"))), 4).alias("norm"))


HASHING_SQL = "SELECT item_id AS passage_id, 64 AS n, 1.0::DOUBLE AS norm FROM benchmark"

QUERIES = {
    "ngrams": (ngrams, NGRAMS_SQL),
    "candidate_topk": (candidate_topk, TOPK_SQL),
    "candidate_interleave": (candidate_interleave, INTERLEAVE_SQL),
    "dedupe_candidates": (dedupe_candidates, DEDUPE_SQL),
    "phrase_candidates": (phrase_candidates, CANDIDATES_SQL),
    "phrase_vectors": (phrase_vectors, VECTORS_SQL),
    "highlight_scores": (highlight_scores, HIGHLIGHT_SQL),
    "highlight_select": (highlight_select, SELECT_SQL),
    "group_results": (group_results, GROUP_SQL),
    "passage_results": (passage_results, PASSAGE_SQL),
    "phrase_pool": (phrase_pool, POOL_SQL),
    "classify_changes": (classify_changes, CLASSIFY_SQL),
    "apply_changes": (apply_changes, APPLY_SQL),
    "index_status": (index_status, STATUS_SQL),
    "phrase_dictionary": (phrase_dictionary, DICTIONARY_SQL),
    "index_stats": (index_stats, STATS_SQL),
    "index_validation": (index_validation, VALIDATE_SQL),
    "health_state": (health_state, HEALTH_SQL),
    "debounce_sessions": (debounce_sessions, DEBOUNCE_SQL),
    "latest_wins": (latest_wins, LATEST_SQL),
    "stale_results": (stale_results, STALE_SQL),
    "missing_files": (missing_files, MISSING_SQL),
    "hashing_embedding": (hashing_embedding, HASHING_SQL),
}
