"""Conversations as training windows of bounded length, with a loss mask and reversible escapes.

Prefix sums of turn tokens cut a conversation into cells of equal budget. Turns
that lie inside a cell form a span; a turn across a border is a span of its own.
So a span holds at most the cell's tokens unless one turn alone has more. A
window is the system turn, a few turns before the span (repeats, not trained
on), and the span's turns. Every assistant turn is under the mask exactly once.

Roles and texts are escaped so that no control string of this or other common
templates occurs in them. Nulls count as empty texts and roles; turns with equal
numbers are ordered by role and text, repeated rows are turns of their own, and
rows without a conversation id form one conversation. All of it is built-in
functions; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
# A bracket that would open a control string; the escape sets one backslash behind it.
_CONTROL = r"([<\[])(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\||/?s>|/?INST\])"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS, TURN_TOKENS = 512, 2, 128, 3


def escape(text: Column) -> Column:
    """Backslashes are doubled first, so that a single one can only be an escape."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def windows(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS,
) -> DataFrame:
    """A row per window: conv_id, window, formatted, repeated (leading turns seen before), loss (places under the mask)."""
    turns = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.regexp_count("text", F.lit(r"\S+")) + TURN_TOKENS
    counted = turns.withColumn("size", size.cast("long")).select(
        "*", F.row_number().over(order).alias("nr"), F.sum("size").over(upto).alias("end"),
        F.first(F.when(F.col("role") == "system", F.struct("role", "text", "size"))).over(upto).alias("system"),
    )
    heading = (F.col("nr") == 1) & F.col("system").isNotNull()
    taken = F.coalesce("system.size", F.lit(0))
    cell = F.greatest(F.lit(budget - history_tokens) - taken, F.lit(1))
    before = F.col("end") - F.col("size") - taken
    first, last = F.floor(before / cell), F.floor((F.col("end") - taken - 1) / cell)
    span = F.when(~heading, 2 * first + (last > first).cast("long"))
    spanned = counted.select("*", heading.alias("heading"), before.alias("before"), span.alias("span"))
    spanned = spanned.withColumn("begins", ~F.col("heading") & ~F.lag("span").over(order).eqNullSafe(F.col("span")))
    later = [F.lead(F.struct("span", "begins", "before")).over(order).alias("later1")] + [
        F.lead(F.struct("span", "begins", "before"), k).over(order).alias(f"later{k}") for k in range(2, history_turns + 1)
    ]
    ahead = spanned.select("*", *later)

    def copy(use: Column, window: Column, place: Column, new: Column, role: Column, text: Column) -> Column:
        return F.when(use, F.struct(
            window.alias("window"), place.alias("place"), new.alias("new"), role.alias("role"), text.alias("text"),
        ))

    role, text, nr = F.col("role"), F.col("text"), F.col("nr").cast("long")
    own = F.when(F.col("heading"), F.coalesce("later1.span", F.lit(0).cast("long"))).otherwise(F.col("span"))
    copies = [copy(F.lit(True), own, nr, F.lit(True), role, text)]
    # The first span's window has the system turn itself.
    repeats = F.col("begins") & F.col("system").isNotNull() & (F.col("nr") > 2)
    copies.append(copy(repeats, F.col("span"), F.lit(0).cast("long"), F.lit(False), F.col("system.role"), F.col("system.text")))
    for k in range(1, history_turns + 1):
        near = F.col(f"later{k}.before") - F.col("before") <= history_tokens
        use = ~F.col("heading") & F.col(f"later{k}.begins") & near
        copies.append(copy(use, F.col(f"later{k}.span"), nr, F.lit(False), role, text))
    rows = ahead.select("conv_id", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())).alias("copy")).select(
        "conv_id", "copy.window", F.struct("copy.place", "copy.new", escape(F.col("copy.role")).alias("role"), escape(F.col("copy.text")).alias("text")).alias("turn"),
    )
    grouped = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    pieces = F.transform("turns", lambda t: F.concat(F.lit(TURN), t.role, F.lit(TEXT), t.text, F.lit(END)))
    made = grouped.withColumn("pieces", pieces)
    starts = F.transform(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: F.struct(
            (F.aggregate(F.slice("pieces", 1, i - 1), F.lit(0), lambda n, p: n + F.length(p))
             + len(TURN) + F.length(F.element_at("turns", i).role) + len(TEXT)).alias("start"),
            F.length(F.element_at("turns", i).text).alias("length"),
            (F.element_at("turns", i).new & (F.element_at("turns", i).role == "assistant")).alias("trained"),
        ),
    )
    return made.select(
        "conv_id", "window", F.array_join("pieces", "").alias("formatted"),
        F.size(F.filter("turns", lambda t: ~t.new)).alias("repeated"),
        F.transform(F.filter(starts, lambda s: s.trained), lambda s: F.struct(s.start.alias("start"), s.length.alias("length"))).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The windows' new turns and trained texts as parsed from what was written: conv_id, window, turns, trained, n_chars."""
    parts = F.slice(F.split("formatted", r"<\|turn\|>"), 2 + F.col("repeated"), F.size(F.split("formatted", r"<\|turn\|>")))
    turns = F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"),
    ))
    trained = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s.length)))
    return formatted.select("conv_id", "window", turns.alias("turns"), trained.alias("trained"), F.length("formatted").alias("n_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """A row per conversation with counts and digests of what its windows say."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    per_window = read_back(formatted).select(
        "conv_id", F.size("turns").alias("n"), "n_chars",
        F.struct("window", said.alias("said"), F.array_join("trained", "").alias("trained")).alias("part"),
    )
    joined = per_window.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts"),
    )
    trained = F.array_join(F.transform("parts", lambda p: p.trained), "")
    return joined.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("parts", lambda p: p.said), ""), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"), "formatted_chars",
    )
