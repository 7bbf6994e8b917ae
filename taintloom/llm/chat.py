"""Chat formatting with a grammar that reads back what was written, with SQL functions alone.

    conversation = turn*      turn = "<s>" role "[INST]" text "</s>"  |  "<s>" role "[INST!]" text "</s>"

The parser cuts at every "</s>", takes the role up to the first mark and the text behind it. Each turn is
first rendered as it is, parsed and compared; where that does not give back role and text, or one of them holds
a control string, it is rendered with the mark "[INST!]" and both escaped: no "<" or "[" is left in them, so no control string can be.
Escaping changes single characters and is undone exactly, so one more round is always enough; what is escaped is
parsed and compared too. The joined conversation is parsed once more as a whole and compared to its turns; if it
differed, every turn of it would be escaped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MARK, MARK_ESCAPED, CLOSE = "<s>", "[INST]", "[INST!]", "</s>"
TURN = "array<struct<role:string,text:string>>"


def escape(s: Column) -> Column:
    out = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(s: Column) -> Column:
    """In escaped text a run of backslashes starts a pair, so cutting at pairs from the left is exact."""
    part = lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.array_join(F.transform(F.split(s, r"\\\\", -1), part), "\\")


def parse(formatted: Column) -> Column:
    """The turns of a rendered text: array of (role, text)."""
    pieces = F.split(formatted, CLOSE, -1)

    def turn(piece: Column) -> Column:
        plain, escaped = F.instr(piece, F.lit(MARK)), F.instr(piece, F.lit(MARK_ESCAPED))
        is_escaped = (escaped > 0) & ((plain == 0) | (escaped < plain))
        at = F.when(is_escaped, escaped).otherwise(plain)
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        text = F.substring(piece, at + F.when(is_escaped, len(MARK_ESCAPED)).otherwise(len(MARK)), F.char_length(piece))
        return F.struct(F.when(is_escaped, unescape(role)).otherwise(role).alias("role"), F.when(is_escaped, unescape(text)).otherwise(text).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def _escaped(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(MARK_ESCAPED), escape(text), F.lit(CLOSE))


def render(role: Column, text: Column) -> Column:
    """One turn; escaped where role or text holds a control string or the plain form does not read back as it was."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    plain = F.concat(F.lit(OPEN), role, F.lit(MARK), text, F.lit(CLOSE))
    control = reduce(Column.__or__, [F.contains(x, F.lit(c)) for x in (role, text) for c in (OPEN, MARK, MARK_ESCAPED, CLOSE)])
    escaped = _escaped(role, text)
    lost = F.raise_error(F.lit("a turn does not read back"))
    return F.when(~control & (parse(plain) == source), plain).when(parse(escaped) == source, escaped).otherwise(lost)


def whole(shown: Column) -> Column:
    """The turns as one text that reads back to them: joined as they are, or else all escaped."""
    own = F.flatten(F.transform(shown, parse))
    joined = F.array_join(shown, "")
    return F.when(parse(joined) == own, joined).otherwise(F.array_join(F.transform(own, lambda t: _escaped(t["role"], t["text"])), ""))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, formatted, turns (read back from it).

    Null roles and texts are empty. Rows of one turn number are ordered by their rendered form, repeated
    rows are turns of their own, null numbers come first; rows without conv_id are one conversation.
    An empty table gives an empty table. A conversation is one value and must fit one; rendering and
    escaping are done before rows are gathered.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), render(F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))).alias("shown")).alias("x")
    )
    shown = F.transform(F.array_sort(F.collect_list("x"), _nulls_first), lambda x: x["shown"])
    out = rows.groupBy("conv_id").agg(shown.alias("shown"))
    return out.select("conv_id", whole(F.col("shown")).alias("formatted")).withColumn("turns", parse(F.col("formatted")))


def _nulls_first(a: Column, b: Column) -> Column:
    by = lambda x, y: F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(0)
    first = by(a["turn"], b["turn"])
    return F.when(first != 0, first).otherwise(by(a["shown"], b["shown"]))


def loss_text(turns: str, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"].isin(*roles)), lambda t: t["text"]), "")


def loss_spans(roles: tuple[str, ...] = ("assistant",)) -> Column:
    """The mask over `formatted`: (start, stop) in code points of each text of those roles, as rendered."""
    pieces = F.split("formatted", CLOSE, -1)
    start = F.struct(F.array().cast("array<struct<start:long,stop:long>>").alias("spans"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, piece: Column) -> Column:
        n = F.char_length(piece)
        plain, escaped = F.instr(piece, F.lit(MARK)), F.instr(piece, F.lit(MARK_ESCAPED))
        is_escaped = (escaped > 0) & ((plain == 0) | (escaped < plain))
        at = F.when(is_escaped, escaped + len(MARK_ESCAPED)).otherwise(plain + len(MARK)) - 1
        raw = F.substring(piece, F.lit(len(OPEN) + 1), F.when(is_escaped, escaped).otherwise(plain) - len(OPEN) - 1)
        role = F.when(is_escaped, unescape(raw)).otherwise(raw)
        span = F.array(F.struct((a["at"] + at).cast("long").alias("start"), (a["at"] + n).cast("long").alias("stop")))
        return F.struct(F.when(role.isin(*roles), F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"), (a["at"] + n + len(CLOSE)).cast("long").alias("at"))

    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step, lambda a: a["spans"])
