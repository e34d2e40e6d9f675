"""Chat formatting by grammar round trip, with DataFrame functions only.

A turn is written `<s>` role `\\n` text `</s>`; a conversation is the run of its turns. A deterministic parser reads
that back: it splits at `</s>`, wants `<s>` first and nowhere else, takes the role up to the first line end and
undoes the escapes. Each turn is first rendered as it is and parsed again; where the parse differs from the source,
the conflicting content is escaped (`&` as `&amp;`, the `<` of a control string as `&lt;`, a line end in a role as
`&nl;`) and parsed once more. As the grammar is prefix-free, a conversation parses into the parses of its turns; the
column `round_trips` states for each conversation that the whole text was parsed back to the source.

Defined cases: null text or role counts as empty; rows of a conversation are taken by (turn, role, text), null turns
first; repeated rows are repeated turns; a null conv_id is a conversation of its own; an empty table gives no rows;
extra columns are ignored. A conversation is one output string, so its turns do meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, CLOSE = "<s>", "</s>"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(F.replace(out, F.lit(OPEN), F.lit("&lt;s>")), F.lit(CLOSE), F.lit("&lt;/s>"))
    return F.replace(out, F.lit("\n"), F.lit("&nl;")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("&nl;"), F.lit("\n")) if role else text
    return F.replace(F.replace(out, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def parse(rendered: Column) -> Column:
    """array<struct<role,text>>, or null where the text isn't of the grammar."""
    parts = F.split(rendered, CLOSE)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    well = (F.element_at(parts, -1) == "") & F.forall(turns, lambda t: t.startswith(OPEN) & (F.instr(F.substr(t, F.lit(4)), OPEN) == 0) & (F.instr(t, "\n") > 0))

    def turn(t: Column) -> Column:
        end = F.instr(t, "\n")
        role = F.substr(t, F.lit(len(OPEN) + 1), end - len(OPEN) - 1)
        return F.struct(unescape(role, role=True).alias("role"), unescape(F.substr(t, end + 1)).alias("text"))

    return F.when(well, F.transform(turns, turn))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, turns (the source), formatted, loss_spans, round_trips.

    loss_spans holds the place of each assistant text inside `formatted`, in code points (start, stop) and in UTF-8
    bytes (byte_start, byte_stop), still escaped as it stands there.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain = render(F.col("role"), F.col("text"))
    source = F.array(F.struct("role", "text"))
    safe = F.coalesce(parse(plain) == source, F.lit(False))
    turns = turns.withColumn("role_out", F.when(safe, F.col("role")).otherwise(escape(F.col("role"), role=True)))
    turns = turns.withColumn("text_out", F.when(safe, F.col("text")).otherwise(escape(F.col("text"))))
    turns = turns.withColumn("piece", render(F.col("role_out"), F.col("text_out")))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.lit(len(OPEN) + 1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + lead + F.char_length("role_out")
    byte_start = F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)) + lead + F.octet_length("role_out")
    turns = turns.withColumns({"start": start, "byte_start": byte_start})
    span = F.struct("start", (F.col("start") + F.char_length("text_out")).alias("stop"), "byte_start", (F.col("byte_start") + F.octet_length("text_out")).alias("byte_stop"))
    each = F.struct("turn", F.col("start").alias("place"), "role", "text", "piece", span.alias("span"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("t"))
    convs = convs.select(
        "conv_id",
        F.transform("t", lambda t: F.struct(t["role"], t["text"])).alias("turns"),
        F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["role"] == "assistant"), lambda t: t["span"]).alias("loss_spans"),
    )
    return convs.withColumn("round_trips", F.coalesce(parse(F.col("formatted")) == F.col("turns"), F.lit(False)))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    data = formatted.cast("binary")
    return F.transform(spans, lambda s: unescape(F.substr(data, (s["byte_start"] + 1).cast("int"), (s["byte_stop"] - s["byte_start"]).cast("int")).cast("string")))
