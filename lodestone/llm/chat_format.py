"""Chat formatting with Spark expressions only.

Turns are collected per conversation and sorted, adjacent turns of one role are merged into one block by array
functions, and the blocks are concatenated::

    ### user:
    first text</turn>
    second text of the same role</turn>
    ### assistant:
    reply</turn>

``</turn>`` ends a turn and ``### role:`` opens a block. Inside texts and roles ``&`` becomes ``&amp;``, ``</turn>`` becomes
``&lt;/turn>`` and each ``#`` that starts ``###`` becomes ``&#35;``, so that no text can hold a control string, and the
original is restored exactly.

Defined cases: a null text or role is empty; a null conversation id is a conversation of its own; turns are ordered by
(turn, role, text), nulls first, so repeated rows and ties are kept in a fixed order; an empty table gives no rows; other
columns are ignored. A conversation is one output value, so its size is bounded by that of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running, table

END = "</turn>\n"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("</turn>"), F.lit("&lt;/turn>"))
    return F.regexp_replace(c, "#(?=##)", "&#35;")


def unescape(c: Column) -> Column:
    for mark, plain in (("&#10;", "\n"), ("&#35;", "#"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, text) rows -> conv_id, formatted, loss_spans: array<struct<start, length>>.

    Spans are in code points from 0 and hold exactly the escaped texts of ``loss_roles``.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    index = F.sequence(F.lit(0), F.size("turns") - 1)
    first = lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])
    starts = sorted_turns.withColumn("starts", F.filter(index, first))
    header = lambda r: F.concat(F.lit("### "), F.replace(escape(r), F.lit("\n"), F.lit("&#10;")), F.lit(":\n"))

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        return F.struct(F.get("turns", start)["role"].alias("role"), header(F.get("turns", start)["role"]).alias("header"), F.transform(F.slice("turns", start + 1, end - start), lambda t: escape(t["text"])).alias("texts"))

    blocks = starts.select("conv_id", F.transform("starts", block).alias("blocks"))
    joined = F.array_join(F.transform("blocks", lambda b: F.concat(b["header"], F.array_join(F.transform(b["texts"], lambda t: F.concat(t, F.lit(END))), ""))), "")
    # What stands before each text, its length, and whether it counts for the loss.
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, i: F.struct(F.when(i == 0, F.length(b["header"])).otherwise(0).alias("skip"), F.length(t).alias("keep"), b["role"].isin(*loss_roles).alias("loss")))))
    laid = blocks.select("conv_id", joined.alias("formatted"), pieces.alias("pieces"))
    size = lambda p: p["skip"] + p["keep"] + len(END)
    starts = running(F.col("pieces"), F.lit(0), lambda at, p: at + size(p), lambda at, n: at + n)
    spans = F.zip_with("pieces", starts, lambda p, at: F.struct((at + p["skip"]).alias("start"), p["keep"].alias("length"), p["loss"].alias("loss")))
    spoken = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return laid.select("conv_id", "formatted", spoken.alias("loss_spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: conv_id, turns: array<struct<role, text>>, loss_text."""
    cut = formatted.select("conv_id", "formatted", "loss_spans", F.split("formatted", "### ", -1).alias("parts"))
    cut = cut.withColumn("blocks", F.slice("parts", 2, F.size("parts") - 1))

    def turns_of(b: Column) -> Column:
        role = unescape(F.substring_index(b, ":\n", 1))
        texts = F.split(F.substr(b, F.instr(b, F.lit(":\n")) + 2), END, -1)
        return F.transform(F.slice(texts, 1, F.size(texts) - 1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return cut.select("conv_id", "formatted", F.flatten(F.transform("blocks", turns_of)).alias("turns"), F.array_join(loss, "").alias("loss_text"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    data = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = parse_chats(format_chats(data.unionByName(more)))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op1_chat_format": op1_chat_format}

#: The same digests, from the turns as they were and the template's lengths.
ORACLE_SQL = {
    "op1_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(text, '&', '&amp;'), '</turn>', '&lt;/turn>') AS x,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM t),
n AS (
  SELECT *, length(x) + 4 * greatest(0, coalesce(list_sum(list_transform(regexp_extract_all(x, '#+'), lambda r: greatest(0, length(r) - 2))), 0)) + 8
         + CASE WHEN p IS NULL OR p <> role THEN 6 + length(role) ELSE 0 END AS chars FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id"""
}
