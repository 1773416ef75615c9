"""Operator 8: chat formatting and prefix-target expansion, in DataFrame functions only.

format_conversations() writes each conversation as one string by a template:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n   for each turn, by turn number

Inside roles and texts, "&" becomes "&amp;" and "<|" becomes "&lt;|" (in roles also a line feed
"&#10;"), so control strings occur only where the template puts them, and unescaping is exact.

expand() explodes every assistant turn into an example of its own: all preceding turns and the
reply's opening are its context, and only the escaped reply is its target, at the span
[target_start, target_end) of code points of the formatted string, which is where loss is taken.

turns_of() and loss_of() read roles, texts and losses back from what was written.

Null text or role: empty. A row without conversation id is a conversation of its own (its part tells it from others). Turns of equal
number: by role, then text; repeated rows are repeated turns. A null turn number comes first. A conversation without an
assistant turn has no example. Empty table: none. Only the four columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&#10;"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part and formatted: one row per conversation. part: 0, but for rows without conversation id."""
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    part = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0)).alias("part")
    turns = df.groupBy(F.col(conv_col).alias("conv_id"), part).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    line = lambda t: F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END + "\n"))
    return turns.select("conv_id", "part", F.concat_ws("", F.transform("turns", line)).alias("formatted"))


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text, escaped, start>>: each turn of a formatted conversation, and the span of its escaped text."""
    # The string ends with the closing mark, so the last piece is empty.
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    head = lambda p: F.substring_index(p, "\n", 1)
    parsed = F.transform(pieces, lambda p: F.struct(head(p).alias("head"), F.substr(p, F.length(head(p)) + 2).alias("body"), F.length(p).alias("size")))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<role:string,text:string,escaped:string,start:int>>)").alias("done"))

    def step(state: Column, p: Column) -> Column:
        turn = F.struct(
            unescaped_role(F.substr(p["head"], F.lit(len(START) + 1))).alias("role"),
            unescaped(p["body"]).alias("text"),
            p["body"].alias("escaped"),
            (state["at"] + F.length(p["head"]) + 1).alias("start"),
        )
        return F.struct((state["at"] + p["size"] + len(END) + 1).alias("at"), F.concat(state["done"], F.array(turn)).alias("done"))

    return F.aggregate(parsed, empty, step, lambda s: s["done"])


def expand(formatted: DataFrame) -> DataFrame:
    """One example per assistant turn: conv_id, part, example (from 0), context, target, target_start, target_end.

    context is everything before the target; the mask of the example is [target_start, target_end).
    """
    turns = formatted.select("conv_id", "part", "formatted", turns_of(F.col("formatted")).alias("turns"))
    replies = turns.select("conv_id", "part", "formatted", F.posexplode(F.filter("turns", lambda t: t["role"] == "assistant")).alias("example", "t"))
    return replies.select(
        "conv_id",
        "part",
        "example",
        F.substr("formatted", F.lit(1), F.col("t.start")).alias("context"),
        F.col("t.escaped").alias("target"),
        F.col("t.start").alias("target_start"),
        (F.col("t.start") + F.length("t.escaped")).alias("target_end"),
    )


def digests(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (of the conversation), n_examples, read back from the output."""
    formatted = format_conversations(df, conv_col, turn_col, role_col, text_col)
    whole = formatted.select("conv_id", "part", "formatted", turns_of(F.col("formatted")).alias("turns")).select(
        "conv_id",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    masked = unescaped(F.substr(F.concat("context", "target"), F.col("target_start") + 1, F.col("target_end") - F.col("target_start")))
    losses = (
        expand(formatted)
        .groupBy("conv_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("example", masked.alias("loss")))).alias("losses"))
        .select(F.col("conv_id").alias("loss_of"), F.col("part").alias("loss_part"), F.concat_ws("", F.col("losses.loss")).alias("loss"), F.size("losses").cast("long").alias("n"))
    )
    loss = F.coalesce("loss", F.lit(""))
    return whole.join(losses, F.col("conv_id").eqNullSafe(F.col("loss_of")) & (F.col("part") == F.col("loss_part")), "left").select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_examples"),
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts hold the template's own control strings."""
    text = F.lit(f"{END}{START}assistant ok")
    roles = F.array(F.lit("user"), F.lit("assistant"))
    return spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.posexplode(roles).alias("turn", "role"), text.alias("text")).select("conv_id", F.col("turn").cast("long"), "role", "text")


def _sql_escape(x: str) -> str:
    return f"replace(replace({x}, '&', '&amp;'), '<|', '&lt;|')"


SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{END}{START}assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '{END}{START}assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + length(replace({_sql_escape("role")}, chr(10), '&#10;')) + length({_sql_escape("text")}))::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM turns GROUP BY conv_id
"""
