"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written as ``<|role|>\\ntext<|end|>\\n``. In roles and texts ``&`` becomes ``&amp;``
and ``<`` becomes ``&lt;`` (in roles also ``|`` becomes ``&#124;``), so no text holds a control
string and every text comes back exactly.

Turns of a conversation are ordered by turn, role and text. Prefix sums of their tokens
(an estimate: 4 and a quarter of the bytes) choose the windows. With room = budget - history, a
turn of more than room / 4 tokens is long. A long turn is a window of its own. The others, between
two long ones, are cut by their own prefix sums: turn t belongs to window floor(tokens before t /
span), where span = room - room / 4 - tokens of the system turn. So windows are aligned to turns.
A window repeats, before its own turns, the conversation's first turn if that is a system turn,
and (unless it is a long turn's) those turns of the window before that begin at most `history`
tokens before the span. Repeated turns are masked: the loss spans cover only the texts of the
window's own assistant turns, each once over all windows.

Budget: system turn, history and own turns begin within history + span tokens and the last one ends
at most room / 4 later, so they fit. A window exceeds its budget only where a long turn with the
system turn does (turns are never cut), or a system turn is longer than half the room.

Defined cases: null texts and roles are empty; null turns come first; repeated rows are turns
of their own; other columns are ignored; an empty table gives an empty result. Scale: a
conversation's prefix sums are taken in blocks of 64 turn numbers, then over the blocks' sums,
so a conversation with a third of all rows is not sorted in one task; windows are bounded by
their budget. Only `digests` gathers a conversation, because its digests are of whole
conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("&#124;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#124;"), F.lit("|")))


def placed(turns: DataFrame, long: int) -> DataFrame:
    """Adds each turn's place in its conversation, the tokens before it, the segment between
    turns of more than `long` tokens (odd: such a turn itself) and the system turn's tokens."""
    tokens = F.lit(4) + F.ceil(F.octet_length("text") / 4).cast("long")
    rows = turns.withColumns({"tokens": tokens, "block": F.floor(F.coalesce("turn", F.lit(-(2**62))) / BLOCK)})
    inner = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_long = (F.col("tokens") > long).cast("long")
    rows = rows.withColumns({"inner_place": F.count("*").over(inner), "inner_tokens": F.sum("tokens").over(inner), "inner_long": F.sum(is_long).over(inner)})
    opens = F.max(F.when((F.col("inner_place") == 1) & (F.col("role") == "system"), F.col("tokens")).otherwise(0))
    sums = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"), F.sum(is_long).alias("long"), opens.alias("opens"))
    outer = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = [F.coalesce(F.sum(x).over(outer), F.lit(0)).alias(y) for x, y in (("n", "places"), ("sum", "before"), ("long", "longs"))]
    sums = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *before, F.first("opens").over(first).alias("system"))
    joined = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    segment = 2 * (F.col("longs") + F.col("inner_long")) - is_long
    return joined.select("conv_id", "role", "text", "tokens", (F.col("places") + F.col("inner_place") - 1).alias("place"), (F.col("before") + F.col("inner_tokens") - F.col("tokens")).alias("start"), segment.alias("segment"), "system")


def windows(conversations: DataFrame, budget: int = 512, history: int = 64) -> DataFrame:
    """Rows (conv_id, window, text, n_context, loss array<struct<start, end>>, n_turns):
    formatted windows; n_context of their turns are repeated; loss in code points."""
    room = budget - history
    if history < 0 or room < 4:
        raise ValueError("history must be at least 0 and well below the budget")
    long = room // 4
    base = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    turns = placed(base, long)
    span = F.greatest(room - long - F.col("system"), F.lit(long))
    k = F.floor(F.col("start") / span)
    opens = (F.col("place") == 0) & (F.col("role") == "system")
    again = ~opens & (F.col("tokens") <= long) & ((k + 1) * span - F.col("start") <= history)
    # Neither the segment nor k ever falls, so their sum tells windows apart and orders them.
    kinds = F.array(F.struct(k.alias("k"), F.lit(2).alias("kind")), F.when(again, F.struct((k + 1).alias("k"), F.lit(1).alias("kind"))))
    own = turns.select("conv_id", "segment", "place", "role", "text", "start", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("w")).select("conv_id", "segment", "w.k", "w.kind", "place", "role", "text")
    # The system turn of a conversation goes to all its later windows.
    system = turns.where(opens).select(F.col("conv_id").alias("c"), "place", "role", "text", F.col("segment").alias("s0"), k.alias("k0"))
    later = turns.where("system > 0").select("conv_id", "segment", k.alias("k")).distinct().join(system, F.col("conv_id").eqNullSafe(F.col("c"))).where("segment != s0 or k != k0")
    kept = own.unionByName(later.select("conv_id", "segment", "k", F.lit(0).alias("kind"), "place", "role", "text"))
    grouped = kept.groupBy("conv_id", "segment", "k").agg(F.array_sort(F.collect_list(F.struct("kind", "place", "role", "text"))).alias("turns")).where(F.exists("turns", lambda t: t["kind"] == 2))
    grouped = grouped.select("conv_id", (F.col("segment") + F.col("k")).alias("window"), "turns")

    written = F.transform("turns", lambda t: F.struct(t["kind"].alias("kind"), t["role"].alias("role"), F.concat(F.lit("<|"), escape_role(t["role"]), F.lit("|>\n")).alias("head"), escape(t["text"]).alias("body")))
    pieces = grouped.select("conv_id", "window", written.alias("t"))
    tail = "<|end|>\n"
    loss = F.expr(
        f"""aggregate(t, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint, end:bigint>>)),
        (a, x) -> named_struct(
            'at', a.at + length(x.head) + length(x.body) + {len(tail)},
            'spans', if(x.kind = 2 and x.role = 'assistant', array_append(a.spans, named_struct('start', a.at + length(x.head), 'end', a.at + length(x.head) + length(x.body))), a.spans)
        ), a -> a.spans)"""
    )
    text = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(tail))), "")
    return pieces.select("conv_id", "window", text.alias("text"), F.size(F.filter("t", lambda x: x["kind"] < 2)).alias("n_context"), loss.alias("loss"), F.size("t").alias("n_turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Rows (conv_id, window, turns, loss_text, formatted_chars) parsed from the text:
    the window's own turns (role, text), and all text under its loss mask, unescaped."""
    parts = F.split("text", r"<\|end\|>\n", -1)
    own = F.slice(parts, F.col("n_context") + 1, F.col("n_turns") - F.col("n_context"))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "|>\n", 1)
        return F.struct(unescape_role(F.substr(head, F.lit(3))).alias("role"), unescape(F.substr(p, F.char_length(head) + 4)).alias("text"))

    said = F.array_join(F.transform("loss", lambda s: F.substr("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), "")
    return formatted.select("conv_id", "window", F.transform(own, turn).alias("turns"), unescape(said).alias("loss_text"), F.char_length("text").cast("long").alias("formatted_chars"))


def digests(parsed: DataFrame) -> DataFrame:
    """One row per conversation: counts and digests of what `read_back` gives."""
    part = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = parsed.select("conv_id", "formatted_chars", F.size("turns").cast("long").alias("n"), F.char_length("loss_text").cast("long").alias("loss"), F.struct("window", part.alias("said"), F.col("loss_text")).alias("w"))
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("loss").alias("loss_chars"), F.sum("formatted_chars").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("w"))
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("w.said"), ""), 256).alias("turns_sha256"), "loss_chars", F.sha2(F.array_join(F.col("w.loss_text"), ""), 256).alias("loss_sha256"), "formatted_chars"
    )
