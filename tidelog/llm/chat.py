"""Chat formatting by grammar round trip, in native functions only.

A turn reads ``### Role: text</turn>`` and a newline; a conversation is its turns. One
deterministic parser reads it back: split at ``</turn>`` + newline, header up to the
first unescaped ``": "``, then every backslash gives its next character. A turn is rendered
and read back as it is; where that does not give it back, or a control string would stand
in its text, the text is escaped. Then the whole conversation is rendered and read back,
and has to be the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template: fixed values.
HEAD, SEP, END = "### ", ": ", "</turn>"
#: Roles shown with a capital; any other role is shown as it is, escaped.
SHOWN = {"system": "System", "user": "User", "assistant": "Assistant"}


def escape(text: Column) -> Column:
    """Reversible: afterwards no control string is left in the text."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(END), F.lit("<\\/turn>"))
    return F.regexp_replace(text, "#(?=##)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _show_role(role: Column) -> Column:
    escaped = F.regexp_replace(escape(role), ":", r"\\:")
    shown = F.when(role.isin(list(SHOWN.values())), F.concat(F.lit("\\"), escaped)).otherwise(escaped)
    for name, capital in SHOWN.items():
        shown = F.when(role == name, F.lit(capital)).otherwise(shown)
    return shown


def _read_role(shown: Column) -> Column:
    role = unescape(shown)
    for name, capital in SHOWN.items():
        role = F.when(shown == capital, F.lit(name)).otherwise(role)
    return role


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; fields that are no turn are null."""
    parts = F.split(formatted, END + "\n", -1)
    parts = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    head = r"(?s)^### ((?:[^:\\]++|\\.)*+): "

    def turn(part: Column) -> Column:
        shown = F.regexp_extract(part, head, 1)
        body = F.regexp_replace(part, head, "")
        return F.struct(_read_role(shown).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def _body(head: Column, role: Column, text: Column) -> Column:
    """The text as it is if a turn with it reads back as it was, without a control string inside; else escaped."""

    def fits(body: Column) -> Column:
        read = parse(F.concat(head, body, F.lit(END + "\n")))
        free = ~F.contains(body, F.lit(END)) & ~F.contains(body, F.lit("###"))
        return free & (F.size(read) == 1) & (F.get(read, F.lit(0))["text"] == text) & (F.get(read, F.lit(0))["role"] == role)

    plain = ~F.contains(text, F.lit("\\")) & ~F.contains(text, F.lit(END)) & ~F.contains(text, F.lit("###"))
    return F.when(plain | fits(text), text).otherwise(escape(text))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, n_turns, turns, loss_spans, identical.

    turns: conv_id, turn, role, text. Rows go by turn, then role, then text; null role or
    text counts as empty; repeated rows are turns of their own; rows with a null conv_id
    form one conversation; texts may have any length. loss_spans are code point spans
    [start, end) of formatted that hold the (escaped) texts of ``loss_role``. ``turns`` is
    what the parser reads back from the whole conversation; one that does not read back as
    it was is an error, so ``identical`` is true in every row. An empty table gives an empty
    table; other columns, whatever their names, are left out.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    sent = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    sent = sent.withColumn("head", F.concat(F.lit(HEAD), _show_role(F.col("role")), F.lit(SEP)))
    sent = sent.withColumn("body", _body(F.col("head"), F.col("role"), F.col("text")))
    # places of the turns by a running sum over the rows, which are already together for the array
    upto = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    sent = sent.withColumn("end", F.sum(F.length("head") + F.length("body") + len(END) + 1).over(upto) - len(END) - 1)
    span = F.struct((F.col("end") - F.length("body")).alias("start"), "end")
    chats = sent.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", span.alias("span"), "role", "text", "head", "body"))).alias("source"))
    pieces = F.transform("source", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n")))
    spans = F.transform(F.filter("source", lambda t: t["role"] == loss_role), lambda t: t["span"])
    chats = chats.select("conv_id", "source", F.array_join(pieces, "").alias("formatted"), spans.alias("loss_spans"))
    chats = chats.withColumn("turns", parse(F.col("formatted")))
    same = F.col("turns") == F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    wrong = F.raise_error(F.concat(F.lit("not read back as it was: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    formatted = F.when(F.col("identical"), F.col("formatted")).otherwise(wrong)
    return chats.withColumn("identical", same).select("conv_id", formatted.alias("formatted"), F.size("turns").cast("bigint").alias("n_turns"), "turns", "loss_spans", "identical")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    texts = F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(texts, "")
