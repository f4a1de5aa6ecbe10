"""Chat formatting by event-sourced reconstruction, in DataFrame functions.

Events (conv_id, seq, turn, kind, role, text) of a conversation are folded in
sequence order into final messages:

    delta        appends its text to the message of its turn
    edit         replaces what the message held so far
    regenerate   replaces the message and discards every later turn so far

Messages are rendered with turn markers; the three characters that markers
and escapes are made of are escaped in texts, so a text can hold any marker
and still be read back exactly.  The loss mask covers assistant texts.

Defined results: null text or role is empty; equal (seq) events are ordered
by kind, role and text; repeated events both count; a conversation id may be
null (one conversation); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENTS = ("conv_id", "seq", "turn", "kind", "role", "text")
NAMED_ROLES = ("user", "assistant", "system", "tool")
END = "</turn>\n"
# character -> escape; the backslash comes first when escaping, last when undoing
_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def _escape(c: Column, rules=_ESCAPES[:3]) -> Column:
    for raw, code in rules:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def _unescape(c: Column, rules=_ESCAPES[:3]) -> Column:
    for raw, code in reversed(rules):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def events_of_rows(rows: DataFrame) -> DataFrame:
    """One delta per stored row, each row its own turn: rows of a conversation
    are numbered by turn (ties by role, then text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    r = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    return (r.withColumn("seq", F.row_number().over(order).cast("bigint"))
            .select("conv_id", "seq", F.col("seq").alias("turn"), F.lit("delta").alias("kind"), "role", "text"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages.  Only windows over a
    conversation's event keys and one group per message; no group is larger
    than the message it builds."""
    e = events.select("conv_id", "seq", "turn", "kind", F.coalesce("role", F.lit("")).alias("role"),
                      F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("_at", F.row_number().over(
        Window.partitionBy("conv_id").orderBy("seq", "turn", "kind", "role", "text")))
    later = Window.partitionBy("conv_id").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("conv_id", "turn").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    e = (e.withColumn("_cut", F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later))
         .withColumn("_gone", F.max(F.col("kind").isin("edit", "regenerate")).over(same))
         .where((F.col("_cut").isNull() | (F.col("turn") < F.col("_cut"))) & ~F.coalesce("_gone", F.lit(False))))
    parts = F.sort_array(F.collect_list(F.struct("_at", "text")))
    return e.groupBy("conv_id", "turn").agg(
        F.min_by("role", "_at").alias("role"), F.array_join(parts["text"], "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans).  ``loss_spans`` has one entry per
    turn in order: where the turn starts, where its text under the loss mask
    starts, and that text's length (0 outside assistant turns), counted in
    code points of ``formatted``."""
    marker = F.when(F.col("role").isin(*NAMED_ROLES), F.initcap("role")).otherwise(
        F.concat(F.lit("@"), _escape(F.col("role"), _ESCAPES)))
    m = (messages.withColumn("_head", F.concat(F.lit("### "), marker, F.lit(": ")))
         .withColumn("_body", _escape(F.col("text")))
         .withColumn("_turn", F.concat("_head", "_body", F.lit(END))))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("_start", F.coalesce(F.sum(F.length("_turn")).over(before), F.lit(0)).cast("bigint"))
    span = F.struct(F.col("_start").alias("turn_start"),
                    (F.col("_start") + F.length("_head")).alias("loss_start"),
                    F.when(F.col("role") == "assistant", F.length("_body")).otherwise(0).cast("bigint").alias("loss_chars"))
    turns = F.sort_array(F.collect_list(F.struct("_start", span.alias("span"), "_turn")))
    return (m.groupBy("conv_id").agg(turns.alias("_t"))
            .select("conv_id", F.array_join(F.col("_t")["_turn"], "").alias("formatted"),
                    F.col("_t")["span"].alias("loss_spans")))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text): turns as array<struct<role,
    text>> parsed from the formatted string; the loss text is cut out by the
    spans and unescaped."""
    pieces = F.split("formatted", END)
    f = formatted.withColumn("_p", F.slice(pieces, F.lit(1), F.size(pieces) - 1))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, ": ", 1)
        mark = F.substr(head, F.lit(5))
        role = F.when(F.startswith(mark, F.lit("@")), _unescape(F.substr(mark, F.lit(2)), _ESCAPES)).otherwise(F.lower(mark))
        return F.struct(role.alias("role"), _unescape(F.substr(p, F.length(head) + 3)).alias("text"))

    def under(p: Column, s: Column) -> Column:
        at = (s["loss_start"] - s["turn_start"] + 1).cast("int")
        return _unescape(F.substr(p, at, s["loss_chars"].cast("int")))
    return f.select("conv_id", "formatted", F.transform("_p", turn).alias("turns"),
                    F.array_join(F.zip_with("_p", "loss_spans", under), "").alias("loss_text"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> (conv_id, formatted, loss_spans)."""
    return render(fold(events_of_rows(rows)))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted output."""
    r = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                    F.sha2(said, 256).alias("turns_sha256"),
                    F.length("loss_text").cast("bigint").alias("loss_chars"),
                    F.sha2("loss_text", 256).alias("loss_sha256"),
                    F.length("formatted").cast("bigint").alias("formatted_chars"))
