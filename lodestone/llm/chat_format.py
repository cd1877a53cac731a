"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Each assistant turn becomes an example: all turns before it as context, and the
turn itself, of which only the reply's text is trainable. Turns that follow the
last assistant turn are no example; so that what is written holds all of a
conversation, they go into one row more, marked untrainable, whose letters the query
counts apart (``rest_chars``).

Template of a turn: ``<|role|>`` newline, text, ``<|end|>`` newline. In roles and
texts ``~``, ``<`` and ``[`` are written ``~0``, ``~1`` and ``~2`` (in roles also
``|`` as ``~3``): no control string, ours or ``</s>`` or ``[INST]``, can stand in a
formatted text but where the template puts it, and reading back restores it.

Cases: a null text or role is empty; a null conversation id is a conversation;
turns with equal numbers go by role, then text, repeated rows stay; a table
without rows gives none; further columns are ignored.

An example must hold all turns before its target, so the longest conversation
bounds a row; rows of different conversations never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

END = "<|end|>\n"
HEAD_LEN = len("<|assistant|>\n")
#: The escapes, in the order of escaping; reading back goes the other way round.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))


def escape(c: Column) -> Column:
    for raw, coded in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    c = F.replace(c, F.lit("~3"), F.lit("|"))
    for raw, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(raw))
    return c


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, example_no, trainable, formatted, loss_start, loss_length.

    ``loss_start`` (from 0) and ``loss_length`` are the code points of the reply's
    escaped text in ``formatted``; both 0 where nothing is trainable.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    rendered = F.transform(
        "turns",
        lambda t: F.concat(
            F.lit("<|"), F.replace(escape(t["role"]), F.lit("|"), F.lit("~3")), F.lit("|>\n"), escape(t["text"]), F.lit(END)
        ),
    )
    targets = F.expr("filter(sequence(1, size(turns)), i -> turns[i - 1].role = 'assistant' OR i = size(turns))")
    examples = grouped.select(
        "conv_id",
        rendered.alias("rendered"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("replies"),
        F.explode(targets).alias("example_no"),
    )
    context = F.array_join(F.slice("rendered", F.lit(1), F.col("example_no") - 1), "")
    target = F.element_at("rendered", F.col("example_no"))
    reply = F.element_at("replies", F.col("example_no"))
    return examples.select(
        "conv_id",
        "example_no",
        reply.alias("trainable"),
        F.concat(context, target).alias("formatted"),
        F.when(reply, F.length(context) + HEAD_LEN).otherwise(0).alias("loss_start"),
        F.when(reply, F.length(target) - HEAD_LEN - len(END)).otherwise(0).alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.split(formatted, r"<\|end\|>\n")
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(3)), "|>\n", 1)).alias("role"),
            unescape(F.substr(p, F.locate("|>\n", p) + 3)).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    return unescape(F.substr(formatted, start + 1, length))


def digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from them."""
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example_no").alias("whole"),
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("trainable"),
                    F.struct("example_no", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("text")),
                )
            )
        ).alias("losses"),
        F.coalesce(F.sum(F.when(F.col("trainable"), F.length("formatted").cast("long"))), F.lit(0)).alias("formatted_chars"),
        F.coalesce(F.sum(F.when(~F.col("trainable"), F.length("formatted").cast("long"))), F.lit(0)).alias("rest_chars"),
        F.count_if("trainable").alias("n_examples"),
    )
    turns = read_turns(F.col("whole"))
    loss = F.array_join(F.transform("losses", lambda x: x["text"]), "")
    return per.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted_chars", "rest_chars", "n_examples").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "rest_chars",
        "n_examples",
    )


#: The two turns of conversation -1.
PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return digest(format_chats(rows.unionByName(probe)))


_ESC = "replace(replace(replace({0}, '~', '~0'), '<', '~1'), '[', '~2')"
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), r AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length(replace({_ESC.format('role')}, '|', '~3')) + length({_ESC.format('text')}) + 13)
      OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS formatted_chars,
  coalesce(sum(upto) FILTER (role <> 'assistant' AND i = n), 0)::BIGINT AS rest_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM r GROUP BY conv_id
"""
