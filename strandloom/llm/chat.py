"""Relational chat formatting: collected turn structs, sorted, merged and concatenated by Spark expressions.

A turn block is `<|im_start|>role\\ntext<|im_end|>\\n`; the texts of adjacent rows of one role share a
block, parted by `<|turn|>`. Control strings inside texts and roles are escaped (`<` to `&lt;`, `[` to
`&#91;`, and the `&` of anything that already looks escaped to `&amp;`), so that a tokenizer meets only
the template's own, and unescaping gives every text back. A line feed in a role is escaped as `&#10;`, as a role
ends with its line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, load, running

START, END, TURN = "<|im_start|>", "<|im_end|>\n", "<|turn|>"


def escape(text: Column) -> Column:
    t = F.regexp_replace(text, r"&(?=(?:amp|lt|#91);)", "&amp;")
    t = F.regexp_replace(t, r"<(?=/?s>|<?/?SYS>>|\|)", "&lt;")
    return F.regexp_replace(t, r"\[(?=/?INST\])", "&#91;")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&#91;"), F.lit("[")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("&#10;"), F.lit("&amp;#10;")), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("&#10;"), F.lit("\n")), F.lit("&amp;#10;"), F.lit("&#10;")))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: spans (start, length in code points) of the assistant's texts.

    Rows are sorted by turn, then role and text, so that ties have one order; null turns come first, null
    text and roles are empty. Repeated rows are turns of their own. Null conv_ids form one conversation.
    Other columns are ignored; an empty table gives an empty result. A conversation is one output row,
    so it has to fit a task.
    """
    t = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    c = c.withColumn("ts", F.transform("ts", lambda x: F.struct(x["role"].alias("role"), escape_role(x["role"]).alias("head"), escape(x["text"]).alias("body"))))
    # head: what stands before a turn's text; the first of a run of one role opens the block
    opens = lambda x, i: F.when(
        (i > 0) & (F.get("ts", i - 1)["role"] == x["role"]), F.lit(TURN)
    ).otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), x["head"], F.lit("\n")))
    c = c.withColumn("ts", F.transform("ts", lambda x, i: F.struct(x["role"].alias("role"), opens(x, i).alias("head"), x["body"].alias("body"))))
    # a text starts where all turns before it and its own head end
    length = lambda x: F.char_length(x["head"]) + F.char_length(x["body"])
    before = running(F.transform("ts", length), lambda a, x: a + x, F.lit(0))
    span = lambda x, at: F.when(x["role"] == "assistant", F.struct((at + F.char_length(x["head"])).alias("start"), F.char_length(x["body"]).alias("length")))
    loss = F.array_compact(let(before, lambda starts: F.zip_with("ts", starts, span)))
    whole = F.concat(F.array_join(F.flatten(F.transform("ts", lambda x: F.array(x["head"], x["body"]))), ""), F.lit(END))
    return c.select("conv_id", whole.alias("formatted"), loss.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """chats with turns (role, text) parsed from the formatted string, and loss_text cut from it by the loss mask."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")
    head = lambda b: F.substring_index(F.substring(b, F.lit(len(START) + 1), F.char_length(b)), "\n", 1)
    body = lambda b: F.substring(b, F.char_length(head(b)) + len(START) + 2, F.char_length(b))
    one = lambda b: F.transform(F.split(body(b), r"<\|turn\|>"), lambda x: F.struct(unescape_role(head(b)).alias("role"), unescape(x).alias("text")))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return chats.withColumn("turns", F.flatten(F.transform(blocks, one))).withColumn("loss_text", loss)


#: The conversation that op5 adds.
PROBE_TEXT = "</s>[INST] ok [/INST]"


def op5_chat(spark, sf_dir):
    real = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    c = read_back(formatted(real.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS same,
  length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '&(amp|lt|#91);', '&amp;\1;', 'g'), '<(/?s>)', '&lt;\1', 'g'), '<(<?/?SYS>>)', '&lt;\1', 'g'), '<(/SYS>>)', '&lt;\1', 'g'), '<\|', '&lt;|', 'g'), '\[(/?INST\])', '&#91;\1', 'g')) AS n
  FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN same THEN 8 ELSE 12 + length(role) + 1 + 11 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
