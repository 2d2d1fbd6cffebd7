r"""Chat formatting with a verified grammar round trip.

Template, for each turn in order: ``<s>[INST]`` role ``\n`` text ``[/INST]</s>\n``. A conversation is
reparsed by splitting at the turn's end mark, so no text may show a control string. Where one does, the
recovered turn differs from its source and the text is escaped: a backslash goes after the first
character of each control string (and of those already escaped so, one more). The parser takes one
backslash off again and refuses a text with a control string in it. Escaping is repeated until what
the parser recovers is identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
TURN_OPEN = "<s>[INST]"
TURN_CLOSE = "[/INST]</s>\n"
#: A control string, with any backslashes after its first character.
CONTROL_RE = r"(<|\[)(\\*)(/?s>|/?INST\])"
ESCAPED_RE = r"(<|\[)\\(\\*)(/?s>|/?INST\])"
#: A control string as such, which no role or text may hold in the output.
RAW_RE = r"</?s>|\[/?INST\]"
MAX_ROUNDS = 3


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_RE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED_RE, r"$1$2$3")


def encode_role(role: Column) -> Column:
    r"""Role names hold no line break in the output: backslash and \n are written as \\ and \n."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def decode_role(role: Column) -> Column:
    return F.array_join(F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(TURN_OPEN), role, F.lit("\n"), body, F.lit(TURN_CLOSE))


def parse_parts(formatted: Column) -> Column:
    """The turns between the marks: array of the turns' strings without their closing marks."""
    parts = F.split(formatted, r"\[/INST\]</s>\n", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def parse_turn(part: Column) -> Column:
    """Role and text of one turn's string; null in place of what breaks the grammar."""
    read = lambda x: F.when(~x.rlike(RAW_RE), unescape(x))
    at = F.locate("\n", part)
    head = F.substring(part, len(TURN_OPEN) + 1, at - len(TURN_OPEN) - 1)
    return F.struct(decode_role(read(head)).alias("role"), read(F.substring(part, at + 1, F.length(part))).alias("text"))


def parse(formatted: Column) -> Column:
    """The turns read back: array<struct<role, text>>."""
    return F.transform(parse_parts(formatted), parse_turn)


def _settled(text: Column, render_one, same, rounds: int) -> Column:
    """The first of text, escape(text), escape(escape(text)) ... that reads back identical."""
    forms = [text]
    for _ in range(rounds):
        forms.append(escape(forms[-1]))
    out = forms[-1]
    for form in reversed(forms[:-1]):
        out = F.when(same(parse(render_one(form))), form).otherwise(out)
    # A text without any sign that starts a control string is settled as it is.
    return F.when(text.rlike(CONTROL_RE), out).otherwise(text)


def format_chats(turns: DataFrame, max_rounds: int = MAX_ROUNDS, loss_role: str = "assistant") -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) -> one row per conversation.

    Returns conv_id, formatted (the whole string), loss_spans (array of struct<turn_start, start,
    length>, code points from 0, the loss mask: the loss role's texts), and round_trip (boolean: the
    reparsed turns equal the source's).

    Nulls: a null text or role reads as empty; null conv_ids form one conversation; a null turn
    comes first. Turns with equal numbers, and repeated rows, all stay, ordered by role, then text.
    Empty tables give no rows; other columns are ignored. A conversation is one row, as its string is;
    the rendering and offsets are computed per turn before rows are gathered.
    """
    src = turns.select("conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role_raw = encode_role(F.col("role"))
    one = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    role_form = _settled(role_raw, lambda r: render(r, F.lit("")), lambda got: got == F.array(F.struct(F.col("role").alias("role"), F.lit("").alias("text"))), max_rounds)
    made = src.withColumn("head", role_form)
    made = made.withColumn("body", _settled(F.col("text"), lambda b: render(F.col("head"), b), lambda got: got == one, max_rounds))
    made = made.withColumn("piece", render(F.col("head"), F.col("body")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    made = made.select(
        "conv_id", "role", "text", "piece",
        F.row_number().over(order).alias("n"),
        (F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece")).alias("turn_start"),
        (F.length("head") + F.lit(len(TURN_OPEN) + 1)).alias("into"),
        F.length("body").alias("length"),
    )
    grouped = made.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text", "piece", "turn_start", "into", "length"))).alias("t"))
    loss = F.filter("t", lambda x: x["role"] == loss_role)
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(loss, lambda x: F.struct((x["n"] - 1).alias("turn_at"), x["turn_start"].alias("turn_start"), (x["turn_start"] + x["into"]).alias("start"), x["length"].cast("long").alias("length"))).alias("loss_spans"),
        source.alias("source"),
    ).select("conv_id", "formatted", "loss_spans", (parse(F.col("formatted")) == F.col("source")).alias("round_trip"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings hold, read back by parser and loss mask alone."""
    turn_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    span_text = F.transform(
        "loss_spans",
        lambda s: unescape(F.substring(F.element_at(F.col("parts"), (s["turn_at"] + 1).cast("int")), (s["start"] - s["turn_start"] + 1).cast("int"), s["length"].cast("int"))),
    )
    return (
        formatted.withColumn("parts", parse_parts(F.col("formatted")))
        .withColumn("turns", F.transform("parts", parse_turn))
        .withColumn("loss_text", F.array_join(span_text, ""))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(turn_text.cast("binary"), 256).alias("turns_sha256"),
            F.length("loss_text").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "round_trip",
        )
    )
