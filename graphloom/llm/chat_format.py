"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A turn is `<turn>role<says>text</turn>`; these three never stand inside an escaped role or text.
TURN, SAYS, END = "<turn>", "<says>", "</turn>"
ASSISTANT = "assistant"

_CONTROL = r"<(\\*)(turn>|says>|/turn>)"
_ESCAPED = r"<\\(\\*)(turn>|says>|/turn>)"


def escaped(text: Column) -> Column:
    r"""`text` with a backslash more after the `<` of each control string, such as `<\turn>`, or `<\\turn>` for that."""
    return F.regexp_replace(text, _CONTROL, r"<\\$1$2")


def unescaped(text: Column) -> Column:
    """What `escaped` was given."""
    return F.regexp_replace(text, _ESCAPED, "<$1$2")


def chat_examples(turns: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_chars and is_whole: one row for each assistant turn.

    `turns` has conv_id, turn, role and text; other columns are not looked at. A conversation's turns go by turn (null
    first), those with the same number by what they are formatted to; equal rows each stay. A null role or text is an
    empty one; rows without a conv_id are one conversation. `text` is the formatted conversation up to and with the reply, and only the reply's characters
    (code points from loss_start, counted from 0) are trained on; they are still escaped there. A conversation that
    doesn't end with an assistant turn, or has none, has one example more, of the whole of it and with nothing to train
    on, so no turn is lost; is_whole marks the example with all turns. Examples are numbered from 0. No turns, no rows.

    Turns are shuffled once, by conversation; an example is a prefix of its conversation's text, so the text is put
    together once and cut for each example after the last shuffle. A conversation is one value, of 2 GB at most.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    body = escaped(text)
    pieces = turns.select(
        "conv_id",
        "turn",
        (role == ASSISTANT).alias("reply"),
        F.concat(F.lit(TURN), escaped(role), F.lit(SAYS), body, F.lit(END)).alias("piece"),
        F.length(body).cast("bigint").alias("chars"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "piece")
    stop = F.sum(F.length("piece").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = pieces.select("conv_id", "reply", "piece", "chars", F.row_number().over(order).alias("at"), stop.alias("stop"))
    whole = placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]), "").alias("whole"),
        F.max("at").alias("n"),
        F.max(F.when(F.col("reply"), F.col("at"))).alias("last_reply"),
        F.sort_array(F.collect_list(F.when(F.col("reply"), F.struct("at", "chars", "stop")))).alias("replies"),
    )
    rest = F.struct(F.col("n").alias("at"), F.lit(0).cast("bigint").alias("chars"), F.length("whole").cast("bigint").alias("stop"))
    targets = F.when(F.col("last_reply") == F.col("n"), F.col("replies")).otherwise(F.concat("replies", F.array(rest)))
    each = whole.select("conv_id", "whole", "n", F.posexplode(targets).alias("example", "target"))
    stop, chars = F.col("target.stop"), F.col("target.chars")
    return each.select(
        "conv_id",
        "example",
        F.substring("whole", F.lit(1), stop.cast("int")).alias("text"),
        (stop - len(END) - chars).alias("loss_start"),
        chars.alias("loss_chars"),
        (F.col("target.at") == F.col("n")).alias("is_whole"),
    )


def read_turns(text: Column) -> Column:
    """The (role, text) pairs that a formatted text was made of."""
    parts = F.filter(F.split(text, END), lambda p: p != "")

    def pair(p: Column) -> Column:
        at = F.locate(SAYS, p)
        role = F.substring(p, F.lit(len(TURN) + 1), at - len(TURN) - 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(p, at + len(SAYS), F.length(p))).alias("text"))

    return F.transform(parts, pair)


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), replies and formatted_chars, from `chat_examples` alone.

    Turns are those of the example with all of them; replies are what the loss masks hold, in order, where an example
    has no target it adds an empty one; formatted_chars sums all examples.
    """
    reply = unescaped(F.substring("text", F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int")))
    parsed = examples.select(
        "conv_id",
        "example",
        F.length("text").cast("bigint").alias("chars"),
        reply.alias("reply"),
        F.when(F.col("is_whole"), read_turns(F.col("text"))).alias("turns"),
    )
    replies = F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda r: r["reply"])
    return parsed.groupBy("conv_id").agg(F.first("turns", ignorenulls=True).alias("turns"), replies.alias("replies"), F.sum("chars").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    """What `read_back` gives as counts and SHA-256 digests."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("replies", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: Conversation -7 of the query: its text holds what a template might use as control strings.
PROBE = r"\### Assistant: </turn> ok"


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    cols = ("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("bigint"), "id", F.when(F.col("id") == 0, "user").otherwise(ASSISTANT), F.lit(PROBE)).toDF(*cols)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*cols).unionByName(probe)
    return digests(read_back(chat_examples(turns)))


OP11_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, i, r, '{PROBE}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS p(i, r)),
p AS (SELECT *, '<turn>' || regexp_replace(role, '<(\\*)(turn>|says>|/turn>)', '<\\\1\2', 'g') || '<says>'
                || regexp_replace(text, '<(\\*)(turn>|says>|/turn>)', '<\\\1\2', 'g') || '</turn>' AS piece FROM c),
t AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, sum(length(piece)) OVER w AS stop
      FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, piece ROWS UNBOUNDED PRECEDING)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS said,
             coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss,
             sum(stop) FILTER (role = 'assistant' OR k = n) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
