"""URL filter: rules first, then empirical-Bayes host reputation.

A labelled page is a binomial trial of its host. Outcomes are counted by host,
registered domain and suffix. At each level the spread of the groups' rates about
their parent's gives the strength of a beta prior (method of moments over all
groups of the level); a group's posterior mean is its own counts shrunk to its
parent's posterior mean. A page is allowed if the lower bound of its host's
posterior, mean - z * sd, reaches ``least``; a host without labels has its
domain's, its suffix's or the whole table's mean.

Outcomes come from what a page says: a page is labelled if at least half of its
sentences (five words or more) stand in labelled documents, and good if the mean
quality of the documents that have them reaches one half. Sentences are met by hash,
each with the sums of its documents' labels, so a sentence that many have is one row.

The registered domain is the last two labels of a host, or three where a general
second label stands before a country's (``co.uk``); an address is its own domain. User
names, ports and a last dot are no part of either.

Cases: a null url or one without ``://`` has an empty host and path, fits no rule
and is judged as the host named by the empty string; pages without a text and documents
without a label are no outcomes, nor are null labels and ids; a document labelled more
than once counts as often; repeated pages stay, each a trial; without any label all
means are one half; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, numbered, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Second labels under which countries (two letters) register domains.
SECOND_LABELS = ("ac", "asso", "co", "com", "ed", "edu", "gob", "gouv", "gov", "govt", "go", "gv", "id", "ltd", "me", "mil", "ne", "net", "nic", "nom", "or", "org", "plc", "res", "sch")
TWO_LABEL_SUFFIX = rf"^({'|'.join(SECOND_LABELS)})\.[a-z]{{2}}$"
ADDRESS = r"^([0-9.]+|\[.*\])$"
ADDRESSES = "(address)"
#: What of a page is no text, tags that part no sentences, and all other tags.
NO_TEXT = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>"
INLINE = r"(?i)</?(a|b|i|u|em|strong|span|small|sub|sup|font|code)(\s[^>]*)?>"
TAG, ENTITY = r"<[^>]*>", r"&([a-zA-Z]+|#[0-9]+);"
END, NO_WORD = r"[.!?\n]+", r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_WORDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    address, two = name.rlike(ADDRESS), F.substring_index(name, ".", -2)
    long = two.rlike(TWO_LABEL_SUFFIX)
    domain = F.when(address, name).when(long, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(address, ADDRESSES).when(long, two).otherwise(F.substring_index(name, ".", -1))


def page_text(html: Column) -> Column:
    """What a page says; tags that part paragraphs become line ends."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, NO_TEXT, "\n"), INLINE, ""), TAG, "\n")
    return F.regexp_replace(plain, ENTITY, " ")


def sentence_hashes(text: Column) -> Column:
    """Distinct hashes of a text's sentences of ``LEAST_WORDS`` words or more, as words in
    lower case; none of a null text."""
    lines = F.regexp_replace(F.translate(text, UPPER, LOWER), END, "\n")
    sentences = F.split(F.regexp_replace(lines, NO_WORD, " "), " *\n *")
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    long = F.filter(F.transform(sentences, F.trim), lambda s: spaces(s) >= LEAST_WORDS - 1)
    return F.coalesce(F.array_distinct(F.transform(long, lambda s: F.xxhash64(s))), F.array().cast("array<bigint>"))


def page_outcomes(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """host, good, n: the labelled pages of every host of ``pages`` (url, html), from
    ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    host, _ = host_and_path(F.col("url"))
    read = numbered(pages.select(host.alias("host"), sentence_hashes(page_text(F.col("html"))).alias("said")), "rid")
    told = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.sum((F.col("quality") > 0).cast("long")).alias("good"), F.count(F.lit(1)).alias("n"))
    known = docs.select("doc_id", sentence_hashes(F.col("text")).alias("said")).filter(F.size("said") > 0).join(told, "doc_id")
    rates = known.select(F.explode("said").alias("h"), "good", "n").groupBy("h").agg((F.sum("good") / F.sum("n")).alias("rate"))
    spread = read.select("rid", F.explode("said").alias("h"))
    # written, so that the join has two plain shuffles, of which AQE can split a sentence that all pages have
    rates = materialize(rates.join(spread.select("h").distinct(), "h", "left_semi"), "rates")
    found = spread.join(rates, "h").groupBy("rid").agg(F.count(F.lit(1)).alias("met"), F.round(F.sum("rate"), 9).alias("rate"))
    good, labelled = (2 * F.col("rate") >= F.col("met")).cast("long"), 2 * F.col("met") >= F.size("said")
    trials = read.join(found, "rid", "left").select("host", F.when(labelled, good).alias("good"), F.coalesce(labelled, F.lit(False)).cast("long").alias("n"))
    return trials.groupBy("host").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.sum("n").alias("n"))


def _shrunk(groups: DataFrame, least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """Adds mean and strength of each group's posterior; has n, good and parent.

    The prior's strength is one number of the level, by moments: the groups'
    squared deviations from their parents, less what binomial chance gives.
    """
    dev = F.col("n") * (F.col("good") / F.col("n") - F.col("parent")) ** 2
    even = F.col("parent") * (1 - F.col("parent"))
    sums = (
        groups.filter("n > 0")
        .agg(
            F.round(F.coalesce(F.sum(dev), F.lit(0.0)), 9).alias("d"),
            F.round(F.coalesce(F.sum(even), F.lit(0.0)), 9).alias("e"),
            F.round(F.coalesce(F.sum(even * F.col("n")), F.lit(0.0)), 9).alias("ne"),
        )
        .first()
    )
    # E[d] = e + rho * (ne - e), rho = 1 / (strength + 1)
    spread = sums.ne > sums.e and sums.d > sums.e
    prior = F.lit(min(most, max(least, (sums.ne - sums.e) / (sums.d - sums.e) - 1)) if spread else most)
    return groups.withColumn("mean", (F.col("parent") * prior + F.col("good")) / (prior + F.col("n"))).withColumn("strength", prior + F.col("n"))


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host, mean, strength, bound from (host, good, n): one row per host seen.

    The driver gets one number per level: the prior's strength.
    """
    domain, suffix = levels(F.col("host"))
    total = F.sum("good").alias("good"), F.sum("n").alias("n")
    hosts = materialize(outcomes.groupBy("host").agg(*total).withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(*total)
    suffixes = domains.groupBy("suffix").agg(*total)
    whole = suffixes.agg(F.coalesce(F.try_divide(F.sum("good"), F.sum("n")), F.lit(0.5))).first()[0]
    top = _shrunk(suffixes.withColumn("parent", F.lit(whole)))
    mid = _shrunk(domains.join(top.select("suffix", F.col("mean").alias("parent")), "suffix"))
    low = _shrunk(hosts.join(mid.select("domain", F.col("mean").alias("parent")), "domain"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    return low.select("host", "mean", "strength", (F.col("mean") - z * sd).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, least: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, bound of every page (page_id, url), from
    outcomes (host, good, n) of all hosts."""
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = read.join(materialize(host_reputation(outcomes).select("host", "bound"), "reputation"), "host", "left")
    own = F.when(F.col("bound") >= least, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("bound", 6).alias("bound"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, page_outcomes(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def _level_sql(name: str, groups: str) -> str:
    return f"""
{name}_s AS (SELECT round(coalesce(sum(n * (good / n - parent) ** 2), 0), 9) AS d, round(coalesce(sum(parent * (1 - parent)), 0), 9) AS e,
  round(coalesce(sum(parent * (1 - parent) * n), 0), 9) AS ne FROM {groups} WHERE n > 0),
{name} AS (SELECT g.*, p.prior + n AS strength, (parent * p.prior + good) / (p.prior + n) AS mean FROM {groups} g,
  (SELECT CASE WHEN ne > e AND d > e THEN least(1000.0, greatest(1.0, (ne - e) / (d - e) - 1)) ELSE 1000.0 END AS prior FROM {name}_s) p)"""


def _sentences_sql(text: str) -> str:
    lines = f"regexp_replace(regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{END}', chr(10), 'g'), '{NO_WORD}', ' ', 'g')"
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array({lines}, ' *\\n *'), lambda s: trim(s, ' ')), lambda s: length(s) - length(replace(s, ' ', '')) >= {LEAST_WORDS - 1}))"


_PAGE_SQL = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{NO_TEXT}', chr(10), 'g'), '{INLINE}', '', 'g'), '{TAG}', chr(10), 'g'), '{ENTITY}', ' ', 'g')"
ORACLE_SQL = f"""
WITH u AS (SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
r AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
f AS (SELECT doc_id, count(*) FILTER (quality > 0) AS good, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT unnest({_sentences_sql('text')}) AS s, good, n FROM documents JOIN f USING (doc_id)),
q AS (SELECT s, sum(good) / sum(n) AS rate FROM k GROUP BY s),
ps AS (SELECT page_id, {_sentences_sql(_PAGE_SQL)} AS said FROM pages),
pq AS (SELECT page_id, count(*) AS met, round(sum(rate), 9) AS rate FROM (SELECT page_id, unnest(said) AS s FROM ps) JOIN q USING (s) GROUP BY page_id),
t AS (SELECT page_id, CASE WHEN 2 * met >= len(said) THEN (2 * rate >= met)::INT END AS good, coalesce(2 * met >= len(said), false)::INT AS n FROM ps LEFT JOIN pq USING (page_id)),
o AS (SELECT host, coalesce(sum(good), 0)::DOUBLE AS good, sum(n)::DOUBLE AS n,
  regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') AS name FROM r JOIN t USING (page_id) GROUP BY host),
o2 AS (SELECT *, regexp_matches(name, '{ADDRESS}') AS ip, regexp_matches(array_to_string(string_split(name, '.')[-2:], '.'), '{TWO_LABEL_SUFFIX}') AS two, string_split(name, '.') AS parts FROM o),
hosts AS (SELECT host, good, n, CASE WHEN ip THEN name ELSE array_to_string(CASE WHEN two THEN parts[-3:] ELSE parts[-2:] END, '.') END AS domain,
  CASE WHEN ip THEN '{ADDRESSES}' ELSE array_to_string(CASE WHEN two THEN parts[-2:] ELSE parts[-1:] END, '.') END AS suffix FROM o2),
domains AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM domains GROUP BY ALL),
w AS (SELECT coalesce(sum(good) / nullif(sum(n), 0), 0.5) AS parent FROM suffixes),
g1 AS (SELECT * FROM suffixes, w), {_level_sql("top", "g1")},
g2 AS (SELECT d.*, t.mean AS parent FROM domains d JOIN top t USING (suffix)), {_level_sql("mid", "g2")},
g3 AS (SELECT x.*, m.mean AS parent FROM hosts x JOIN mid m USING (domain)), {_level_sql("low", "g3")},
b AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (strength + 1)) AS bound FROM low),
v AS (SELECT r.*, b.bound, CASE
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'block example.com/de/'
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'allow example.net/en/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'allow org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'block net/' END AS hit FROM r JOIN b USING (host))
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule, coalesce(split_part(hit, ' ', 1), CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict, round(bound, 6) AS bound FROM v
"""
