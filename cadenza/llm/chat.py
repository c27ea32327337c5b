"""Chat formatting with a grammar round trip (DataFrame functions only).

Grammar.  A conversation is a sequence of turns without anything between them:

    assistant:    <s> text </s>
    other roles:  [INST] role \\n text [/INST]

without the blanks.  The four control strings open and close turns wherever they stand.  One that is
to be read as text has a backslash after its opening: [\\INST] is read as [INST], </\\s> as </s>; of
several backslashes there, reading removes one.  The reader knows nothing but the formatted text.

Turns are written as they are, read again and compared with their source; those that come back
different are written with more escapes, until all are identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A control string, and one with any number of escapes: opening, escapes, name.
CONTROL = r"\[/?INST\]|</?s>"
MARKED = r"(\[/?|</?)(\\*)(INST\]|s>)"
ESCAPED = r"(\[/?|</?)\\(\\*)(INST\]|s>)"
TURNS = "array<struct<role:string,text:string>>"

#: What a turn that comes back different is escaped by, in turn: its control strings, and then
#: also what looks like one that is escaped already.
ESCAPES = [r"(\[/?|</?)()(INST\]|s>)", MARKED]


def escape(text: Column, pattern: str = MARKED) -> Column:
    return F.regexp_replace(text, pattern, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    """A turn; role and text are escaped already.  A role's line feeds are escaped here."""
    return F.when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), role, F.lit("\n"), text, F.lit("[/INST]")))


def _role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _plain_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def parse(formatted: Column) -> Column:
    """The deterministic reader: a formatted text -> array of its turns (role, text).

    The text is cut at its control strings.  An opening one that is followed by its closing one
    is a turn; anything else, other than nothing after a closing one, is a turn without a role.
    """
    marks = F.regexp_extract_all(formatted, F.lit(f"({CONTROL})"))
    parts = F.split(formatted, CONTROL, -1)

    rest = lambda x: F.slice(x, F.lit(2), F.size(x))
    pieces = F.arrays_zip(marks, rest(parts), rest(marks))  # a control string, the text after it, the next control string

    def turn(piece: Column) -> Column:
        mark, inner, following = (piece[str(k)] for k in range(3))
        head = F.instr(inner, "\n")
        other = F.struct(_plain_role(unescape(F.substr(inner, F.lit(1), head - 1))).alias("role"), unescape(F.substr(inner, head + 1)).alias("text"))
        own = F.struct(F.lit("assistant").alias("role"), unescape(inner).alias("text"))
        stray = F.struct(F.lit(None).cast("string").alias("role"), F.concat(mark, inner).alias("text"))
        closing = mark.isin("</s>", "[/INST]") & (inner == "")
        return (
            F.when((mark == "<s>") & (following == "</s>"), own)
            .when((mark == "[INST]") & (following == "[/INST]") & (head > 0), other)
            .when(~closing, stray)
        )

    first = F.get(parts, F.lit(0))
    before = F.when(first == "", F.array().cast(TURNS)).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("role"), first.alias("text"))).cast(TURNS))
    return F.concat(before, F.array_compact(F.transform(pieces, turn)).cast(TURNS))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> each row with _formatted, its turn as it is written.

    A turn is written as it is and read again.  While what is read is not that one turn, the next
    of ESCAPES is applied to its role and text, and it is read again; with the last of them each
    control string, escaped or not, has one escape more than in the source, so that reading gives
    the source.  What a turn is read as depends on nothing but itself, as no control string can
    begin in one turn and end in the next, so that turns are settled before they are put together.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("_name", _role(F.col("role")))
    rows = rows.withColumn("_formatted", render(F.col("_name"), F.col("text")))
    source = F.array(F.struct("role", "text")).cast(TURNS)
    for pattern in ESCAPES:
        rows = rows.withColumn("_same", parse(F.col("_formatted")) == source)
        again = render(escape(F.col("_name"), pattern), escape(F.col("text"), pattern))
        rows = rows.withColumn("_formatted", F.when(F.col("_same"), F.col("_formatted")).otherwise(again))
    return rows.drop("_same", "_name")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Format conversations: conv_id, formatted, turns, loss_spans, round_trip.

    Rows are ordered by turn, then role and text; null roles and texts count as empty; rows of a
    null conv_id are one conversation.  turns is what the reader finds in formatted, the whole
    conversation, and round_trip tells that it is the source.  loss_spans are places of the assistant texts
    in formatted, as written: start and length in code points, byte_start and byte_length in
    UTF-8.  Repeated rows are turns of their own.  An empty table gives an empty one; other
    columns, of whatever name, are not read.
    """
    rows = format_turns(conversations)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sizes = {"": F.length("_formatted"), "byte_": F.octet_length("_formatted")}
    rows = rows.withColumn("_at", F.row_number().over(order))
    rows = rows.withColumns({f"_{k}start": F.coalesce(F.sum(n).over(before), F.lit(0)) for k, n in sizes.items()})
    span = F.struct(*(x for k, n in sizes.items() for x in ((F.col(f"_{k}start") + 3).alias(f"{k}start"), (n - 7).cast("long").alias(f"{k}length"))))
    span = F.when(F.col("role") == "assistant", span)
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_at", "role", "text", "_formatted", span.alias("span")))).alias("_rows"))
    whole = whole.select(
        "conv_id",
        F.array_join(F.col("_rows._formatted"), "").alias("formatted"),
        F.filter(F.col("_rows.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.transform("_rows", lambda r: F.struct(r["role"], r["text"])).cast(TURNS).alias("_source"),
    ).withColumn("turns", parse(F.col("formatted")))
    return whole.select("conv_id", "formatted", "turns", "loss_spans", (F.col("turns") == F.col("_source")).alias("round_trip"))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, in order: what stands in formatted at its spans, unescaped."""
    data = formatted.cast("binary")
    cut = lambda s: F.substring(data, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int"))
    return F.transform(spans, lambda s: unescape(cut(s).cast("string")))


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests: of the turns that
    the reader finds, and of the texts that the loss mask covers."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = formatted.withColumn("_loss", F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), sha(F.col("_loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "round_trip")
