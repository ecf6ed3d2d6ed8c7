"""Chat formatting that survives its own parser, in DataFrame functions only.

Grammar: a conversation is turns, a turn is

    "### " role ": " text "</turn>" line-end

The roles user, assistant and system appear as User, Assistant, System. The
parser cuts at the end marks, takes the role up to the first ": " and reads a
backslash as "the next character, as it is". "###" inside a turn is an error.

Each turn is rendered as it is, parsed again and compared with its source.
Where that differs, backslashes, end marks and "#" in the text are escaped, and
then every character of role, or role and text, until the parser gives back
the source. A text that holds no control string is thus never changed.

Turns are ordered by turn (null first), role, text; rows repeated are turns
repeated. Null roles and texts are empty ones. A null conv_id is a conversation
like others. No rows give no conversations. Other columns are not read. A
conversation becomes one string, so one of over 2 GB fails: it has no such form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MARK, STOP, BETWEEN = "###", "</turn>\n", ": "
SHOWN = {"user": "User", "assistant": "Assistant", "system": "System"}


def _shown(role: Column) -> Column:
    out = role
    for name, shown in SHOWN.items():
        out = F.when(role == name, F.lit(shown)).otherwise(out)
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape(text: Column) -> Column:
    """Backslashes, end marks and "#"."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("#"), F.lit("\\#"))


def escape_all(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)(.)", r"\\$1")


def head(role: Column) -> Column:
    return F.concat(F.lit(MARK + " "), role, F.lit(BETWEEN))


def parse_turn(turn: Column) -> Column:
    """struct(role, text) of a turn without its end mark; null where it breaks the grammar."""
    inside = F.substring(turn, len(MARK) + 2, 2**31 - 1)
    at = F.instr(inside, BETWEEN)
    role, text = F.substring(inside, F.lit(1), at - 1), F.substring(inside, at + len(BETWEEN), F.lit(2**31 - 1))
    named = unescape(role)
    for name, shown in SHOWN.items():
        named = F.when(role == shown, F.lit(name)).otherwise(named)
    sound = turn.startswith(MARK + " ") & (at > 0) & ~F.contains(inside, F.lit(MARK))
    return F.when(sound, F.struct(named.alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    return F.transform(segments(formatted), parse_turn)


def segments(formatted: Column) -> Column:
    """The turns as they stand, without end marks."""
    return F.filter(F.split(formatted, F.lit(STOP), -1), lambda s: s != "")


def _comes_back(role: Column, text: Column, own_role: Column, own_text: Column) -> Column:
    parts = F.split(F.concat(head(role), text, F.lit(STOP)), F.lit(STOP), -1)
    got = parse_turn(parts[0])
    return F.coalesce((F.size(parts) == 2) & (got["role"] == own_role) & (got["text"] == own_text), F.lit(False))


def format_turns(rows: DataFrame) -> DataFrame:
    """The rows with shown_role and body: the least escaping that the parser undoes."""
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    role, text = F.col("role"), F.col("text")
    shown = _shown(role)
    forms = [(shown, text), (shown, escape(text)), (escape_all(role), escape(text))]
    best = F.struct(escape_all(role).alias("shown_role"), escape_all(text).alias("body"))
    for r, t in reversed(forms):
        best = F.when(_comes_back(r, t, role, text), F.struct(r.alias("shown_role"), t.alias("body"))).otherwise(best)
    return rows.withColumn("form", best).select("conv_id", "turn", "role", "text", "form.*")


def format_conversations(rows: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask.

    The mask has, for each turn of role `learn_from`: the number of the turn,
    the code points before its text in the turn (`at`) and in the whole
    (`start`), and the code points of the text as it stands (`length`).
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = (
        format_turns(rows)
        .withColumn("whole", F.concat(head(F.col("shown_role")), "body", F.lit(STOP)))
        .withColumn("at", F.length(head(F.col("shown_role"))))
        .withColumn("number", F.row_number().over(order) - 1)
        .withColumn("before", F.coalesce(F.sum(F.length("whole").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    )
    span = F.struct(F.col("number").alias("turn"), "at", (F.col("before") + F.col("at")).alias("start"), F.length("body").alias("length"))
    found = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("number", "whole"))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("role") == learn_from, span))).alias("loss_mask"),
    )
    return found.select("conv_id", F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"), "loss_mask")


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    parts = segments(formatted)
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(parts[m["turn"]], m["at"] + 1, m["length"]))), "")
