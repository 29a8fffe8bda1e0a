r"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A turn is written `### role: text</turn>` and a newline. Inside roles and texts a backslash goes before every backslash,
before a slash that follows `<`, before a `#` that follows another, and in roles before a colon: no control string is
left, and dropping each backslash (keeping what follows) restores the text. Every assistant turn becomes an example: all
turns before it, its own header, and its text, the only part between loss_start and loss_end. A closing row for each
conversation holds all turns with nothing to train on, so that what follows the last reply is in the output too.

Scale: one shuffle by conversation, which the order of its turns needs; examples are cut from its turns by slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

HEAD, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
#: Turns that the query formats besides the table's: control strings in a text, as user and as assistant.
PLANTED = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def escape(col: Column) -> Column:
    col = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    col = F.replace(col, F.lit("</"), F.lit("<\\/"))
    return F.regexp_replace(col, "(?<=#)#", r"\\#")


def escape_role(col: Column) -> Column:
    return F.replace(escape(col), F.lit(":"), F.lit("\\:"))


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 1), text, loss_start, loss_end (code points, end exclusive; null in the closing row).

    conversations: conv_id, turn, role, text; other columns are left out. Null texts and roles are empty; turns are in
    the order of turn (nulls first), then role, then text; repeated rows are turns of their own; rows with a null
    conv_id are one conversation. A conversation without assistant turns has its closing row only.
    """
    turns = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    row = F.struct("turn", "role", "text", F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(AFTER_ROLE)).alias("head"), escape(F.col("text")).alias("body"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    numbers = F.sequence(F.lit(1), F.size("turns") + 1)
    targets = F.filter(numbers, lambda i: (i > F.size("turns")) | (F.get("turns", i - 1)["role"] == ASSISTANT))
    each = whole.select("conv_id", "turns", F.posexplode(targets).alias("k", "at"))
    before = F.array_join(F.transform(F.expr("slice(turns, 1, at - 1)"), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    each = each.select("conv_id", (F.col("k") + 1).cast("int").alias("example"), before.alias("before"), F.expr("get(turns, at - 1)").alias("target"))
    start = F.length(F.concat("before", "target.head"))
    return each.select(
        "conv_id",
        "example",
        F.concat("before", F.coalesce(F.concat("target.head", "target.body", F.lit(END)), F.lit(""))).alias("text"),
        start.cast("bigint").alias("loss_start"),
        (start + F.length("target.body")).cast("bigint").alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what the formatted text itself says: turns (role, text), losses (texts under the mask), chars."""
    closing = F.col("loss_start").isNull()
    loss = F.struct("example", unescape(F.expr("substring(text, int(loss_start) + 1, int(loss_end - loss_start))")).alias("text"))
    whole = examples.groupBy("conv_id").agg(
        F.max(F.when(closing, F.col("text"))).alias("text"),
        F.sort_array(F.collect_list(F.when(~closing, loss))).alias("losses"),
        F.sum(F.length("text")).cast("bigint").alias("formatted_chars"),
    )
    pieces = F.filter(F.split("text", END, -1), lambda x: x != "")
    pattern = r"(?s)^### ((?:[^:\\]++|\\.)*+): (.*)$"
    turns = F.transform(pieces, lambda x: F.struct(unescape(F.regexp_extract(x, pattern, 1)).alias("role"), unescape(F.regexp_extract(x, pattern, 2)).alias("text")))
    return whole.select("conv_id", turns.alias("turns"), F.transform("losses", lambda x: x["text"]).alias("losses"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame(PLANTED, "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    back = read_back(format_chat(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
size AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</', ''))) // 2
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '##+'), lambda x: length(x) - 1)), 0)
    + length(role) + 4 + 2 + 8 AS chars FROM rows),
run AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM size)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars
FROM run GROUP BY conv_id
"""
