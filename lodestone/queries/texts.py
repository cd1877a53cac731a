"""Queries of text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunk, media
from lodestone.queries.base import FILE_SQL, FOLDER_SQL, MARKDOWN, markdown, read, tokens_sql

NL = "chr(10)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.withColumn("content", markdown(F.col("text"), F.col("doc_id")))


def _path() -> F.Column:
    """A note's path from a page's address."""
    return F.concat(F.regexp_replace("url", r"\A[a-z]+://", ""), F.when(F.col("page_id") % 2 == 0, ".MD").otherwise(".txt"))


_PATH = "regexp_replace(url, '^[a-z]+://', '') || CASE WHEN page_id % 2 = 0 THEN '.MD' ELSE '.txt' END"
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"


def strip_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.strip_frontmatter(F.col("content"))).alias("hash"), F.length(T.strip_frontmatter(F.col("content"))).alias("n"))


_STRIPPED = f"CASE WHEN starts_with(content, '---') THEN trim(substr(content, 4 + length('k: v') + 5), {_BLANK}) ELSE content END"
STRIP_SQL = f"WITH {MARKDOWN} SELECT doc_id, md5({_STRIPPED}) AS hash, length({_STRIPPED})::INTEGER AS n FROM m"


def parse_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(chunk.parse_sections(chunk.cleaned(F.col("content")))).alias("n", "s"))
    return rows.select("doc_id", "n", "s.heading", F.md5("s.text").alias("hash"), "s.line_start", "s.line_end")


SECTIONS_SQL = f"""WITH {MARKDOWN}, c AS (SELECT doc_id, string_split(trim({_STRIPPED}, {_BLANK}), {NL}) AS l FROM m),
l AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM c),
s AS (SELECT *, sum((line = '# Part')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l),
g AS (SELECT doc_id, part, trim(coalesce(string_agg(line, {NL} ORDER BY i) FILTER (line <> '# Part'), ''), {_BLANK}) AS text, min(i) AS line_start, max(i) AS line_end FROM s GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1)::INTEGER AS n, CASE WHEN part > 0 THEN 'Part' ELSE '' END AS heading, md5(text) AS hash,
  line_start::INTEGER AS line_start, line_end::INTEGER AS line_end FROM g WHERE text <> ''"""


def chunk_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), F.lit(0).cast("long").alias("mtime"), "content")
    return chunk.passages(notes).select("file", "chunk_no", "heading", F.md5("text").alias("hash"), "line_start", "line_end")


# Long sections' paragraphs are dealt in order, a row a step, as the room that is left for
# one depends on all before it.
CHUNK_SQL = f"""WITH RECURSIVE {MARKDOWN}, c AS (SELECT doc_id, trim({_STRIPPED}, {_BLANK}) AS t FROM m),
l AS (SELECT doc_id, unnest(string_split(t, {NL})) AS line, unnest(range(len(string_split(t, {NL})))) AS i FROM c WHERE length(t) > 1600),
s AS (SELECT *, sum((line = '# Part')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l),
g AS (SELECT doc_id, part, trim(coalesce(string_agg(line, {NL} ORDER BY i) FILTER (line <> '# Part'), ''), {_BLANK}) AS text, min(i) AS lo, max(i) AS hi FROM s GROUP BY ALL),
b AS (SELECT doc_id, part, lo, hi, unnest(string_split_regex(text, '\n\n+')) AS p, unnest(range(len(string_split_regex(text, '\n\n+')))) AS i FROM g WHERE length(text) > 2400),
r AS (SELECT doc_id, part, i, 0 AS k, length(p) + 2 AS size FROM b WHERE i = 0
  UNION ALL SELECT b.doc_id, b.part, b.i, CASE WHEN r.size + length(b.p) > 2400 THEN r.k + 1 ELSE r.k END, CASE WHEN r.size + length(b.p) > 2400 THEN 0 ELSE r.size END + length(b.p) + 2
  FROM r JOIN b ON b.doc_id = r.doc_id AND b.part = r.part AND b.i = r.i + 1),
k AS (SELECT b.doc_id, b.part, r.k, any_value(lo) AS lo, any_value(hi) AS hi, trim(string_agg(p, {NL} || {NL} ORDER BY b.i), {_BLANK}) AS text, sum(length(p) - length(replace(p, {NL}, ''))) + 2 * (count(*) - 1) AS n
  FROM b JOIN r ON r.doc_id = b.doc_id AND r.part = b.part AND r.i = b.i GROUP BY b.doc_id, b.part, r.k),
z AS (SELECT *, lo + coalesce(sum(n + 1) OVER (PARTITION BY doc_id, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, k = max(k) OVER (PARTITION BY doc_id, part) AS last FROM k),
u AS (SELECT doc_id, 0 AS part, 0 AS k, '' AS heading, t AS text, 0 AS a, length(t) - length(replace(t, {NL}, '')) AS b FROM c WHERE length(t) BETWEEN 1 AND 1600
  UNION ALL SELECT doc_id, part, 0, CASE WHEN part > 0 THEN 'Part' ELSE '' END, text, lo, hi FROM g WHERE length(text) BETWEEN 1 AND 2400
  UNION ALL SELECT doc_id, part, k, CASE WHEN part > 0 THEN 'Part' ELSE '' END, text, a, CASE WHEN last THEN hi ELSE a + n END FROM z)
SELECT doc_id::VARCHAR AS file, (row_number() OVER (PARTITION BY doc_id ORDER BY part, k) - 1)::INTEGER AS chunk_no, heading, md5(text) AS hash, a::INTEGER AS line_start, b::INTEGER AS line_end FROM u"""


def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.when(F.col("doc_id") % 2 == 0, "A > B").otherwise("")
    made = T.embedding_text(F.concat(F.lit("Notes/"), F.col("doc_id").cast("string"), F.lit(".md")), heading, F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(made).alias("hash"))


EMBEDDING_TEXT_SQL = f"SELECT doc_id, md5(doc_id || CASE WHEN doc_id % 2 = 0 THEN {NL} || 'A > B' ELSE '' END || {NL} || {NL} || text) AS hash FROM documents"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with links, code and marks around some words."""
    body = F.regexp_replace("text", r"(^| )(th[a-z]+)", "$1[[$2|alias $2]]")
    body = F.regexp_replace(body, r"(^| )(on[a-z]+)", "$1**$2** `code` ![pic](x.png) [site](http://x)")
    body = F.regexp_replace(F.regexp_replace(body, r"\*\*\*", ""), r"\n", "\n- ")
    return read(spark, sf_dir, "documents").select("doc_id", body.alias("body"))


_MARKED = """k AS (SELECT doc_id, replace(replace(regexp_replace(regexp_replace(text, '(^| )(th[a-z]+)', '\\1[[\\2|alias \\2]]', 'g'),
  '(^| )(on[a-z]+)', '\\1**\\2** `code` ![pic](x.png) [site](http://x)', 'g'), '***', ''), chr(10), chr(10) || '- ') AS body FROM documents)"""


def _chain(x: str, steps: tuple[tuple[str, str], ...]) -> str:
    for pattern, to in steps:
        pattern = pattern.replace("'", "''")
        x = f"regexp_replace({x}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"trim({x}, {_BLANK})"


def clean_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("doc_id", F.md5(T.clean_for_index(F.col("body"))).alias("hash"))


# Fixed values, written for SQL on their own, so that a slip in the engine shows.
_CODE_STEPS = (("(?s)```.*?```", " "), ("`([^`]+)`", "$1"))
_PREFIX_STEP = (r"(?m)^\s{0,3}(?:######|#####|####|###|##|#|>|[-*+] |[0-9]+[.)] )\s*", "")
_ONE_SPACE = (r"\s+", " ")
_INDEX_STEPS = (*_CODE_STEPS, (r"!?\[\[?([^\]|]+)(?:\|[^\]]+)?(?:\]\]|\](?:\([^)]*\))?)", "$1"), _PREFIX_STEP, (r"[*_~=#|<>]", " "), _ONE_SPACE)
CLEAN_INDEX_SQL = f"WITH {_MARKED} SELECT doc_id, md5({_chain('body', _INDEX_STEPS)}) AS hash FROM k"


def clean_text_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without single asterisks, whose rule needs look-around."""
    body = F.regexp_replace("body", r"(\*\*)|\*", "$1")
    return _marked(spark, sf_dir).select("doc_id", F.md5(T.clean_for_reader(body)).alias("hash"))


# Fixed values for SQL; without the rule of single asterisks.
_READER = (
    (r"^---\s*(?s:.*?)\n---\s*", ""), *_CODE_STEPS, (r"!\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", "$1"), (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"), (r"\[\[([^\]]+)\]\]", "$1"),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^\s*>\s*\[![^\]]+\][-+]?\s*", ""), _PREFIX_STEP,
    (r"(?m)^\s*\|?\s*:?---+:?\s*(?:\|\s*:?---+:?\s*)+\|?\s*$", " "), (r"\|", " · "), (r"(?:\*\*|__|~~|==)(.*?)(?:\*\*|__|~~|==)", "$1"), ("<[^>]+>", " "),
    (r"(^|\s)#[\p{L}\p{N}_/-]+", "$1"), _ONE_SPACE,
)
CLEAN_RESULT_SQL = f"WITH {_MARKED} SELECT doc_id, md5({_chain('''regexp_replace(body, '(\\*\\*)|\\*', '\\1', 'g')''', _READER)}) AS hash FROM k"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return rows.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


TOKENS_SQL = f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY ALL"
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
# Fixed values for SQL: stop words of lemmas and of terms, irregular forms, words, terms.
STOPS = (
    "a about an and are as at be because been being between but by can could do does for from had has have how i in into is it its may might more my not of on or our "
    "out over she so than that the their them then they this those through to under up vs was we were what when where which while who with without would you your"
).split()
TERM_STOPS = (
    "about after again also and are because been before being between but can could does for from have into more not that the their then there these they this those through "
    "was were what when where which while who with would your"
).split()
FORMS = {"children": "child", "feelings": "feel", "feels": "feel", "felt": "feel", "men": "man", "people": "person", "women": "woman"}
_WORD_SQL = "[\\p{L}\\p{N}][\\p{L}\\p{N}''’.-]*"
_TERM_SQL = "[\\p{L}\\p{N}][\\p{L}\\p{N}''-]*"


def lemma_sql(x: str) -> str:
    w = f"regexp_replace(lower({x}), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')"
    irregular = " ".join(f"WHEN {w} = '{a}' THEN '{b}'" for a, b in FORMS.items())

    def undouble(n: int) -> str:
        c = f"left({w}, length({w}) - {n})"
        return f"CASE WHEN length({c}) > 1 AND right({c}, 1) = left(right({c}, 2), 1) THEN left({c}, length({c}) - 1) ELSE {c} END"

    return f"""CASE {irregular} WHEN length({w}) > 5 AND {w} LIKE '%ing' THEN {undouble(3)} WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y'
 WHEN length({w}) > 4 AND {w} LIKE '%ed' THEN {undouble(2)} WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END"""


def lemma_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select(F.explode(T.all_matches(F.col("text"), T.WORD)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select("word", "n", T.lemma(F.col("word")).alias("lemma"), T.is_stop(T.lemma(F.col("word"))).alias("stop"))


LEMMA_SQL = f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_WORD_SQL}')) AS word FROM documents) GROUP BY word)
SELECT word, n, {lemma_sql('word')} AS lemma, ({lemma_sql('word')}) IN ({_LIST(STOPS)}) AS stop FROM w"""


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.explode(T.query_terms(F.col("text"))).alias("term"))


QUERY_TERMS_SQL = f"""SELECT DISTINCT conv_id, turn, term FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '{_TERM_SQL}')) AS term FROM conversations)
WHERE length(term) > 2 AND term NOT IN ({_LIST(TERM_STOPS)})"""


def query_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.explode(T.query_anchors(F.col("text"))).alias("anchor"))


QUERY_ANCHORS_SQL = f"""SELECT DISTINCT conv_id, turn, {lemma_sql('word')} AS anchor FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{_WORD_SQL}')) AS word FROM conversations)
WHERE length({lemma_sql('word')}) > 2 AND ({lemma_sql('word')}) NOT IN ({_LIST(STOPS)})"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_of = T.split_sentences(T.clean_for_index(F.col("text")))
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(all_of).alias("i", "sentence")).select("doc_id", "i", F.md5("sentence").alias("hash"))


_SENTENCES = f"""t AS (SELECT doc_id, {_chain('text', _INDEX_STEPS)} AS c FROM documents),
f AS (SELECT doc_id, c, list_filter(list_transform(regexp_extract_all(c, '[^.!?\\n]+[.!?]?'), lambda s: trim(s, {_BLANK})), lambda s: s <> '') AS s FROM t),
a AS (SELECT doc_id, CASE WHEN c = '' THEN [] WHEN len(s) > 0 THEN s ELSE [c] END AS s FROM f)"""
SENTENCES_SQL = f"WITH {_SENTENCES} SELECT doc_id, i::INTEGER AS i, md5(x) AS hash FROM (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM a)"


def sample_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"), 12)).alias("i", "s")).select("doc_id", "i", F.md5("s").alias("hash"))


SAMPLE_SQL = f"""WITH {_SENTENCES}, b AS (SELECT doc_id, CASE WHEN len(s) <= 12 THEN s ELSE list_transform(range(12), lambda i: s[floor(i * (len(s) - 1) / 11 + 0.5)::INT + 1]) END AS s FROM a)
SELECT doc_id, i::INTEGER AS i, md5(x) AS hash FROM (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM b)"""


def basename_dirname(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", _path().alias("p"))
    c = T.crumbs(F.col("p"))
    return rows.select("page_id", T.basename(F.col("p")).alias("base"), T.dirname(F.col("p")).alias("dir"), c["name"].alias("name"), F.array_join(c["folders"], ">").alias("folders"))


BASENAME_SQL = f"""SELECT page_id, {FILE_SQL.format('p')} AS base, {FOLDER_SQL.format('p')} AS dir,
  CASE WHEN n = '' THEN 'Vault' ELSE n END AS name, array_to_string(string_split(regexp_replace(p, '(?i)\\.md$', ''), '/')[:-2], '>') AS folders
FROM (SELECT page_id, p, string_split(regexp_replace(p, '(?i)\\.md$', ''), '/')[-1] AS n FROM (SELECT page_id, {_PATH} AS p FROM pages))"""


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", T.fingerprint(F.col("text")).alias("fingerprint"))


def _base36(h: str) -> str:
    digit = lambda k: f"substr('0123456789abcdefghijklmnopqrstuvwxyz', ({h} // {36**k} % 36)::INT + 1, 1)"
    return f"CASE WHEN {h} = 0 THEN '0' ELSE ltrim({' || '.join(digit(k) for k in range(6, -1, -1))}, '0') END"


def _hash(seed: int, factor: int) -> str:
    return f"list_reduce(list_prepend({seed}::HUGEINT, list_transform(string_split(text, ''), lambda c: ord(c)::HUGEINT)), lambda h, c: xor(h, c) * {factor} % 4294967296)"


FINGERPRINT_SQL = f"""WITH h AS (SELECT item_id, text, {_hash(2166136261, 16777619)} AS a, {_hash(2246822507, 3266489909)} AS b FROM benchmark)
SELECT item_id, length(text) || ':' || {_base36('a')} || ':' || {_base36('b')} AS fingerprint FROM h"""

SNIPPET_QUERY = "the thing that was from anth"


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = F.array(F.lit("onth"), F.lit("the and"))
    made = T.distill_snippet(F.regexp_replace("text", r"\*", ""), F.lit(SNIPPET_QUERY), phrases)
    return read(spark, sf_dir, "documents").select("doc_id", made.alias("snippet"))


_SNIPPETS = f"""t AS (SELECT doc_id, {_chain("replace(text, '*', '')", _READER)} AS c FROM documents),
f AS (SELECT doc_id, c, list_filter(list_transform(regexp_extract_all(c, '[^.!?\\n]+[.!?]?'), lambda s: trim(s, {_BLANK})), lambda s: s <> '') AS s FROM t),
a AS (SELECT doc_id, CASE WHEN c = '' THEN [] WHEN len(s) > 0 THEN s ELSE [c] END AS s FROM f),
x AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM a WHERE len(s) > 0),
y AS (SELECT doc_id, s, i, len(list_filter(['thing', 'anth'], lambda t: contains(lower(s[i]), t))) + 3 * len(list_filter(['onth', 'the and'], lambda p: contains(lower(s[i]), p) OR contains(p, lower(s[i])))) AS score FROM x),
b AS (SELECT doc_id, any_value(s) AS s, arg_max(i, (score, -i)) AS i FROM y GROUP BY doc_id),
e AS (SELECT doc_id, s, i, CASE WHEN length(s[i]) < 132 AND i < len(s) THEN s[i] || ' ' || s[i + 1] ELSE s[i] END AS e FROM b),
g AS (SELECT doc_id, CASE WHEN length(e) < 132 AND i > 1 THEN s[i - 1] || ' ' || e ELSE e END AS e FROM e),
sn AS (SELECT a.doc_id, coalesce(CASE WHEN length(e) > 240 THEN regexp_replace(left(e, 240), '\\s+\\S*$', '') || '…' ELSE e END, '') AS snippet FROM a LEFT JOIN g USING (doc_id))"""
SNIPPETS_SQL = f"WITH {_SNIPPETS} SELECT doc_id, snippet FROM sn"


def mark_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = F.array(*map(F.lit, ("the", "and the", "that", "is (a)", "of")))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.mark_phrases(F.col("text"), phrases)).alias("hash"))


# Words and what parts them, one after the other; a marked pair is two words.
MARK_SQL = """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+') AS t FROM documents),
k AS (SELECT doc_id, t, list_transform(t, lambda x: lower(x)) AS l FROM w)
SELECT doc_id, md5(array_to_string(list_transform(range(1, len(t) + 1), lambda i: CASE
  WHEN l[i] = 'and' AND t[i + 1] = ' ' AND l[i + 2] = 'the' THEN '<mark>' || t[i]
  WHEN i > 2 AND l[i] = 'the' AND t[i - 1] = ' ' AND l[i - 2] = 'and' THEN t[i] || '</mark>'
  WHEN l[i] IN ('the', 'that') THEN '<mark>' || t[i] || '</mark>' ELSE t[i] END), '')) AS hash FROM k"""


def in_note_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = media.in_note_matches(rows, F.lit("and the"), T.query_terms(F.lit("and the thing")), F.array(F.lit("of the"), F.lit("The")))
    spread = found.select("doc_id", F.explode("matches").alias("m"))
    return spread.select("doc_id", F.col("m.from").alias("from"), F.col("m.to").alias("to"), F.lower("m.text").alias("text"), F.col("m.line").alias("line"), F.col("m.ch").alias("ch"))


# Matches are found longest phrase first, and none overlaps an earlier one. A phrase's own
# are its occurrences from left to right; as each begins and ends with a whole word and no
# phrase here can overlap itself, the greedy choice is: keep what meets no longer phrase.
# Texts are split by each phrase: places, lines and line starts are sums over the pieces.
_MATCHED = f"""ph AS (SELECT * FROM (VALUES ('and the', 1), ('of the', 3), ('thing', 4), ('the', 5)) t(p, r)),
c AS (SELECT doc_id, p, r, string_split(lower(text), p) AS s FROM src, ph WHERE contains(lower(text), p)),
x AS (SELECT doc_id, p, r, unnest(s) AS x, unnest(range(len(s))) AS j, len(s) AS n FROM c),
y AS (SELECT *, sum(length(x) + length(p)) OVER o - length(p) AS a, sum(length(x) - length(replace(x, {NL}, ''))) OVER o AS line, lead(x) OVER o AS next FROM x WINDOW o AS (PARTITION BY doc_id, p ORDER BY j)),
z AS (SELECT *, max(CASE WHEN contains(x, {NL}) THEN a - length(string_split(x, {NL})[-1]) END) OVER (PARTITION BY doc_id, p ORDER BY j) AS begin FROM y),
w AS (SELECT doc_id, p, r, a, a + length(p) AS b, line, a - coalesce(begin, 0) AS ch FROM z WHERE j < n - 1
  AND (CASE WHEN x <> '' THEN NOT regexp_matches(right(x, 1), '[\\p{{L}}\\p{{N}}]') ELSE j = 0 END) AND (CASE WHEN next <> '' THEN NOT regexp_matches(left(next, 1), '[\\p{{L}}\\p{{N}}]') ELSE j = n - 2 END)),
k AS (SELECT x.* FROM w x WHERE NOT EXISTS (SELECT 1 FROM w y WHERE y.doc_id = x.doc_id AND y.r < x.r AND y.a < x.b AND x.a < y.b))"""
IN_NOTE_SQL = f"""WITH src AS (SELECT doc_id, text FROM documents), {_MATCHED}
SELECT doc_id, a::BIGINT AS "from", b::BIGINT AS "to", p AS text, line::INTEGER AS line, ch::INTEGER AS ch FROM k"""


def node_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines as text nodes."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    nodes = lines.select((F.col("doc_id") * 1_000_000 + F.col("n")).alias("node_id"), "text")
    return media.node_matches(nodes, F.array(*map(F.lit, ("and the", "of the", "thing", "The")))).withColumn("text", F.lower("text"))


NODE_SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, {NL})) AS text, unnest(range(len(string_split(text, {NL})))) AS n FROM documents),
src AS (SELECT doc_id * 1000000 + n AS doc_id, text FROM l), {_MATCHED}
SELECT doc_id AS node_id, a::BIGINT AS "from", b::BIGINT AS "to", p AS text FROM k"""


def offset_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    at = T.offset_to_position(F.col("text"), half)
    return read(spark, sf_dir, "documents").select("doc_id", at["line"].alias("line"), at["ch"].alias("ch"))


OFFSET_SQL = f"""SELECT doc_id, (len(l) - 1)::INTEGER AS line, length(l[-1])::INTEGER AS ch FROM (SELECT doc_id, string_split(left(text, length(text) // 2), {NL}) AS l FROM documents)"""


def formatters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") * F.col("event_id") * 37 % 5_000_000_000
    return read(spark, sf_dir, "events").select(
        "event_id", T.format_bytes(n).alias("bytes"), T.format_elapsed(n % 10_000_000).alias("elapsed"), T.format_percent(F.col("event_id") % 100 / 100.0).alias("percent"),
        T.format_when(F.when(F.col("event_id") % 7 > 0, F.unix_millis(F.col("ts").cast("timestamp")))).alias("at"),
    )


FORMATTERS_SQL = """WITH e AS (SELECT event_id, ts, event_id * event_id * 37 % 5000000000 AS n, event_id * event_id * 37 % 5000000000 % 10000000 AS ms FROM events),
s AS (SELECT *, floor(ms / 1000 + 0.5)::BIGINT AS s FROM e)
SELECT event_id, CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN n || ' B' WHEN n < 1024 ** 2 THEN printf('%.1f KB', round(n / 1024.0, 1)) WHEN n < 1024 ** 3 THEN printf('%.1f MB', round(n / 1024.0 ** 2, 1)) ELSE printf('%.1f GB', round(n / 1024.0 ** 3, 1)) END AS bytes,
  CASE WHEN s < 60 THEN s || 's' ELSE s // 60 || 'm ' || s % 60 || 's' END AS elapsed, printf('%d%%', event_id % 100) AS percent,
  CASE WHEN event_id % 7 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'Never' END AS at FROM s"""


def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" \t"), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n"))
    return read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.md5(T.normalize_query(raw)).alias("hash"), F.md5(T.escape_regex(F.col("text"))).alias("escaped"), F.octet_length("text").alias("bytes"), T.vault_key(F.concat(F.lit("C:\\Vaults\\"), F.col("role"))).alias("key"),
    )


NORMALIZE_SQL = f"""SELECT conv_id, turn, md5(lower(trim(regexp_replace(' ' || chr(9) || replace(text, ' ', '  ') || {NL}, '\\s+', ' ', 'g')))) AS hash,
  md5(regexp_replace(text, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')) AS escaped, strlen(text)::INTEGER AS bytes,
  substr(sha256(lower('C:/Vaults/' || role)), 1, 16) AS key FROM conversations"""


def image_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of derived notes, in order: no phrase occurs."""
    rows = _marked(spark, sf_dir)
    body = F.concat(F.col("body"), F.lit("\n![[pic a.png|x]] <img alt=\"z\" src='http://x/y.jpg'> ![[pic a.png]]"))
    found = media.extract_images(body, F.array().cast("array<string>"))
    return rows.select("doc_id", F.posexplode(found).alias("i", "image")).select("doc_id", "i", "image.target", "image.alt")


IMAGE_SQL = f"""WITH {_MARKED}, i AS (SELECT doc_id, contains(body, '![pic](x.png)') AS has FROM k)
SELECT doc_id, 0 AS i, 'x.png' AS target, 'pic' AS alt FROM i WHERE has
UNION ALL SELECT doc_id, has::INT, 'pic a.png', 'pic a.png' FROM i UNION ALL SELECT doc_id, has::INT + 1, 'http://x/y.jpg', 'z' FROM i"""


def resolve_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four references per page; some pages' second one is in the vault."""
    image = lambda t: F.struct(t.alias("target"), F.lit("a").alias("alt"))
    pages = read(spark, sf_dir, "pages")
    name = F.concat(F.lit("img%20"), (F.col("page_id") % 10).cast("string"), F.lit(".PNG?w=1"))
    images = F.array(image(F.lit("data:x")), image(name), image(F.lit("//cdn/x.png")), image(F.lit("note.md")))
    vault = spark.range(5).select(F.concat(F.lit("img "), F.col("id").cast("string"), F.lit(".PNG")).alias("path"))
    return media.resolve_images(pages.select(F.col("page_id").alias("passage_id"), images.alias("images")), vault, True)


RESOLVE_SQL = "SELECT page_id AS passage_id, CASE WHEN page_id % 10 < 5 THEN 'img ' || (page_id % 10) || '.PNG' ELSE 'https://cdn/x.png' END AS source, 'a' AS alt FROM pages"

QUERIES = {
    "strip_frontmatter": (strip_frontmatter, STRIP_SQL),
    "parse_sections": (parse_sections, SECTIONS_SQL),
    "chunk_notes": (chunk_notes, CHUNK_SQL),
    "embedding_text": (embedding_text, EMBEDDING_TEXT_SQL),
    "clean_text_index": (clean_text_index, CLEAN_INDEX_SQL),
    "clean_text_result": (clean_text_result, CLEAN_RESULT_SQL),
    "tokens": (tokens, TOKENS_SQL),
    "lemma_words": (lemma_words, LEMMA_SQL),
    "query_terms": (query_terms, QUERY_TERMS_SQL),
    "query_anchors": (query_anchors, QUERY_ANCHORS_SQL),
    "sentences": (sentences, SENTENCES_SQL),
    "sample_sentences": (sample_sentences, SAMPLE_SQL),
    "basename_dirname": (basename_dirname, BASENAME_SQL),
    "fingerprint": (fingerprint, FINGERPRINT_SQL),
    "snippets": (snippets, SNIPPETS_SQL),
    "mark_up": (mark_up, MARK_SQL),
    "in_note_matches": (in_note_matches, IN_NOTE_SQL),
    "node_matches": (node_matches, NODE_SQL),
    "offset_position": (offset_position, OFFSET_SQL),
    "formatters": (formatters, FORMATTERS_SQL),
    "normalize_query": (normalize_query, NORMALIZE_SQL),
    "image_refs": (image_refs, IMAGE_SQL),
    "resolve_images": (resolve_images, RESOLVE_SQL),
}
