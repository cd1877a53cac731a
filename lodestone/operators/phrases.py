"""Candidate phrases of a passage: n-grams of one to three words that may be marked.

Part-of-speech tags come from a tagger behind an interface: a column function from
an array of words to an array of arrays of tags. The one given here goes by a small
list of words and by endings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

Tagger = Callable[[Column], Column]

# Nouns too general to be marked alone.
GENERIC = ["answer", "concept", "example", "fact", "idea", "kind", "part", "point", "question", "section", "thing", "thought", "type", "way"]
# Phrases and sentences per field; lengths of a phrase; kept per sentence.
MOST = {"filename": 8, "heading": 8, "body": 24}
SENTENCES = {"filename": 4, "heading": 4, "body": 24}
SHORTEST, LONGEST = 3, 60
MULTI, SINGLE = 3, 5
# What a phrase's parts add to its quality.
NOUN, VERB_FIRST, ADJECTIVE, EXPRESSION, TWO, THREE = 0.04, 0.08, 0.06, 0.07, 0.05, 0.03

_VERBS = ["is", "are", "was", "be", "do", "does", "go", "make", "take", "teach", "read", "write", "give", "find", "keep", "raise", "require", "oppose"]
_EXPRESSIONS = ["oh", "hello", "wow", "please", "thanks", "yes", "ok"]


def suffix_tagger(words: Column) -> Column:
    """Tags by word list and ending; what neither knows is a noun."""

    def tags(w: Column) -> Column:
        low = F.lower(w)
        known = F.when(low.isin(*_EXPRESSIONS), F.array(F.lit("Expression")))
        known = known.when(T.is_stop(low), F.array(F.lit("Function")))
        known = known.when(low.isin(*_VERBS) | T.lemma(low).isin(*_VERBS) | F.concat(T.lemma(low), F.lit("e")).isin(*_VERBS), F.array(F.lit("Verb")))
        known = known.when(low.rlike(r"(?:ous|ful|ive|able|ible|al|ic|less|ish)\z"), F.array(F.lit("Adjective")))
        return known.when(low.endswith("ly"), F.array(F.lit("Adverb"))).otherwise(F.array(F.lit("Noun")))

    return F.transform(words, tags)


def ngrams(words: Column, most: int = 3) -> Column:
    """All runs of 1 to ``most`` items, by start, then by length."""

    def spread(all_: Column) -> Column:
        return F.transform(
            all_,
            lambda _, i: F.transform(
                F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: i + n <= F.size(all_)),
                lambda n: F.struct(i.alias("start"), (i + n - 1).alias("end"), n.alias("words"), F.slice(all_, i + 1, n).alias("run")),
            ),
        )

    return F.flatten(T.bind(words, spread))


def passes_stop_rules(run: Column, size: Column) -> Column:
    """No stop word at the ends, but an article may lead a longer phrase."""
    first, last = F.element_at(run, 1), F.element_at(run, -1)
    article = (size > 1) & first["lemma"].isin("a", "an", "the")
    return (~first["stop"] | article) & ~last["stop"] & F.exists(run, lambda w: ~w["stop"])


def quality(noun: Column, verb_first: Column, adjective: Column, expression: Column, size: Column) -> Column:
    add = lambda c, x: F.when(c, F.lit(x)).otherwise(0.0)
    return add(noun, NOUN) + add(verb_first, VERB_FIRST) + add(noun & adjective, ADJECTIVE) + add(expression, EXPRESSION) + F.when(size == 2, TWO).when(size == 3, THREE).otherwise(0.0)


def _has(tags: Column, *wanted: str) -> Column:
    return F.exists(tags, lambda t: t.isin(*wanted))


def sentence_candidates(sentence: Column, tagger: Tagger = suffix_tagger) -> Column:
    """The phrases of one sentence that pass the rules, with their quality."""
    tagged = T.bind(T.sentence_words(sentence), lambda words: F.zip_with(words, tagger(F.transform(words, lambda w: w["text"])), lambda w, t: w.withField("tags", t)))

    def described(g: Column) -> Column:
        run, size = g["run"], g["words"]
        tags = F.flatten(F.transform(run, lambda w: w["tags"]))
        place = lambda *wanted: F.array_position(F.transform(run, lambda w: _has(w["tags"], *wanted)), True)
        noun, verb, expression, adjective = _has(tags, "Noun", "ProperNoun"), _has(tags, "Verb"), _has(tags, "Expression"), _has(tags, "Adjective")
        at_noun, at_verb = place("Noun", "ProperNoun"), place("Verb")
        return F.struct(
            F.array_join(F.transform(run, lambda w: w["text"]), " ").alias("phrase"),
            g["start"].alias("start"),
            g["end"].alias("end"),
            size.alias("words"),
            noun.alias("has_noun"),
            verb.alias("has_verb"),
            expression.alias("has_expression"),
            (adjective & ~noun & ~verb).alias("adjective_only"),
            quality(noun, (at_verb > 0) & (at_noun > 0) & (at_verb < at_noun), adjective, expression, size).alias("quality"),
            (passes_stop_rules(run, size) & F.when(size == 1, (noun | verb | expression) & ~F.element_at(run, 1)["lemma"].isin(*GENERIC)).otherwise(noun | expression)).alias("fit"),
        )

    made = F.transform(ngrams(tagged), described)
    return F.filter(made, lambda c: c["fit"] & (F.length(c["phrase"]) >= SHORTEST) & (F.length(c["phrase"]) <= LONGEST))


def best_of_sentence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each sentence the best longer phrases, then the best single words; ``level``
    counts them from 0. ``rows`` has quality, words and pos (the order of making)."""
    multi = F.col("words") > 1
    rank = Window.partitionBy(*keys, multi).orderBy(F.desc("quality"), F.desc("words"), "pos")
    kept = rows.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= F.when(multi, MULTI).otherwise(SINGLE))
    level = Window.partitionBy(*keys).orderBy(F.desc(multi), "_rank")
    return kept.withColumn("level", F.row_number().over(level) - 1).drop("_rank")


def interleave(rows: DataFrame, keys: list[str], most: Column) -> DataFrame:
    """Level by level, in each level sentence by sentence, until there are ``most``."""
    order = Window.partitionBy(*keys).orderBy("level", "sentence_id")
    return rows.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= most)


def first_of_each(rows: DataFrame) -> DataFrame:
    """Of phrases that differ in case alone within a passage's field, the first; then
    numbered by field and turn."""
    field = F.when(F.col("field") == "filename", 0).when(F.col("field") == "heading", 1).otherwise(2)
    same = Window.partitionBy("passage_id", "field", F.lower("phrase")).orderBy("turn")
    return (
        rows.withColumn("_n", F.row_number().over(same))
        .filter("_n = 1")
        .drop("_n")
        .withColumn("pos", F.row_number().over(Window.partitionBy("passage_id").orderBy(field, "turn")) - 1)
    )


def candidates(passages: DataFrame, tagger: Tagger = suffix_tagger) -> DataFrame:
    """All candidate phrases of ``passages`` (passage_id, file, heading, text), a row each."""
    sources = [("filename", T.basename(F.col("file"))), ("heading", F.col("heading")), ("body", F.col("text"))]
    fields = F.array(*[F.struct(F.lit(n).alias("field"), T.sentences(c, SENTENCES[n]).alias("s"), F.lit(MOST[n]).alias("most")) for n, c in sources])
    spread = passages.select("passage_id", F.explode(fields).alias("f"))
    spread = spread.select("passage_id", "f.field", "f.most", F.posexplode("f.s").alias("sentence_id", "sentence"))
    made = spread.select("passage_id", "field", "most", "sentence_id", F.posexplode(sentence_candidates(F.col("sentence"), tagger)).alias("pos", "c"))
    made = made.select("passage_id", "field", "most", "sentence_id", "pos", "c.*").drop("fit")
    best = best_of_sentence(made, ["passage_id", "field", "sentence_id"])
    return first_of_each(interleave(best, ["passage_id", "field"], F.col("most"))).drop("most", "level", "turn")
