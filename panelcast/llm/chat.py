r"""Chat formatting with a grammar round trip, in SQL functions only.

Grammar of a formatted conversation (turns in order, nothing between)::

    user       <s>[INST] TEXT [/INST]
    assistant   TEXT </s>                     (one blank before, one after)
    other      <<SYS>>ROLE\nTEXT\n<</SYS>>

Control strings are ``<s> </s> [INST] [/INST] <<SYS>> <</SYS>>``.  A turn is
rendered as it is and parsed again; if its text holds a control string or does
not come back the same, it is escaped: control strings get a backslash after their first
character, and those that have backslashes there already get one more, so that taking one away restores any text.  The whole
conversation is parsed again and must give its turns back, else the row raises.

Rows go by turn (then role and text, nulls first); equal rows are turns of
their own.  Null text is empty, and so is a null role.  A null conversation id
is one conversation.  Role names may hold anything: backslashes and line
feeds in them are written ``\b`` and ``\n``.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = {"user": "<s>[INST] ", "assistant": " ", "other": "<<SYS>>"}, {"user": " [/INST]", "assistant": " </s>", "other": "\n<</SYS>>"}
_CONTROL = r"/?s>|/?INST\]|</?SYS>>"
_ANY = rf"(<|\[)(\\*)({_CONTROL})"
_TURN = r"(?s)<s>\[INST\] .*? \[/INST\]|<<SYS>>.*?\n<</SYS>>| .*? </s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ANY, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<|\[)\\(\\*)({_CONTROL})", "$1$2$3")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def render(role: Column, body: Column) -> Column:
    """One turn; ``body`` must be escaped where it needs to be."""
    return (F.when(role == "user", F.concat(F.lit(OPEN["user"]), body, F.lit(CLOSE["user"])))
            .when(role == "assistant", F.concat(F.lit(OPEN["assistant"]), body, F.lit(CLOSE["assistant"])))
            .otherwise(F.concat(F.lit(OPEN["other"]), _role_out(role), F.lit("\n"), body, F.lit(CLOSE["other"]))))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, unescaped."""
    def turn(m: Column) -> Column:
        def inner(kind: str) -> Column:
            return F.substring(m, F.lit(len(OPEN[kind]) + 1), F.length(m) - len(OPEN[kind]) - len(CLOSE[kind]))
        role = F.substring_index(inner("other"), "\n", 1)
        rest = F.substring(inner("other"), F.length(role) + 2, F.length(m))
        user, assistant = m.startswith(OPEN["user"]), m.startswith(OPEN["assistant"])
        return F.struct(
            F.when(user, F.lit("user")).when(assistant, F.lit("assistant")).otherwise(_role_in(role)).alias("role"),
            unescape(F.when(user, inner("user")).when(assistant, inner("assistant")).otherwise(rest)).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) of rows (conv_id, turn, role,
    text).  A loss span (start from 0, length; code points) is an assistant's text in ``formatted``."""
    source = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    raw = source.withColumn("plain", render(F.col("role"), F.col("text")))
    back = raw.withColumn("back", parse(F.col("plain")))
    same = (F.size("back") == 1) & (F.col("back")[0]["role"] == F.col("role")) & (F.col("back")[0]["text"] == F.col("text"))
    settled = back.withColumn("body", F.when(same & ~F.col("text").rlike(_ANY), F.col("text")).otherwise(escape(F.col("text"))))
    rows = settled.select("conv_id", "turn", "role", "text", F.length("body").alias("size"), render(F.col("role"), F.col("body")).alias("out"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum(F.length("out")).over(before), F.lit(0)))
    # a turn is never empty, so starts order the turns
    whole = (placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "role", "text", "size", "out"))).alias("turns"))
             .withColumn("formatted", F.array_join("turns.out", "")))
    given = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    fine = parse(F.col("formatted")) == given
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.when(fine, F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted conversation does not parse to its turns"))).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == "assistant"),
                    lambda t: F.struct((t["start"] + len(OPEN["assistant"])).cast("long").alias("start"), t["size"].cast("long").alias("length"))
                    ).alias("loss_spans"))


def masked(formatted: Column, spans: Column) -> Column:
    """Texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
