"""Chat formatting in budgeted windows, by DataFrame functions only.

Prefix sums of turn tokens choose spans of whole turns: the sums are cut into cells of ``stride``
tokens, the turns that lie in one cell form a window, and a turn that crosses a cell's edge is a
window of its own. A window begins with the conversation's system turn and with at most ``history``
turns (and ``history_tokens`` tokens) repeated from before it. Only assistant texts that appear for
the first time are under the loss mask; repeated ones are masked.

A conversation is worked on in blocks of ``block`` turn numbers, so that one conversation with a large
part of all rows is dealt over many tasks; windows don't cross blocks, the history does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Tokens that a turn costs besides its words: the two marks, the role and the line break.
TURN_TOKENS = 4
LAST_BLOCK = (1 << 62) - 1


def escape(text: Column) -> Column:
    """Every ``<|`` gets one more bar, so that no control string is left; undone by :func:`unescape`."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def word_tokens(text: Column) -> Column:
    """The default token count: words between the contracts' white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def format_chat(
    conversations: DataFrame,
    budget: int = 2048,
    history: int = 2,
    history_tokens: int = 256,
    system_tokens: int = 256,
    block: int = 4096,
    count=word_tokens,
) -> DataFrame:
    """One row per window: conv_id, block, window, text, loss_spans, n_turns, n_context, tokens, over_budget.

    ``loss_spans`` are (start, stop) in code points of ``text``. The first ``n_context`` turns of a
    window are repeated ones. ``conversations`` has conv_id, turn, role, text; other columns are not read.

    * Turns go by number, null numbers last, equal ones by role and text; repeated rows are all kept.
    * A null text or role is empty; a null conv_id is a conversation like any other.
    * A turn is never cut. A window that one long turn, or a system turn of more than
      ``system_tokens``, takes over the budget says so in ``over_budget``.
    * Only a system turn that opens its conversation is carried to the later windows.
    * An empty table gives no rows.
    """
    stride = budget - history_tokens - system_tokens
    if stride <= 0:
        raise ValueError("the budget must exceed history_tokens + system_tokens")
    number = F.col("turn").cast("long")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.floor(number / block), F.lit(LAST_BLOCK)).alias("block"),
        number.alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", (count(F.col("text")) + TURN_TOKENS).cast("long"))

    w = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    turns = turns.withColumn("pos", F.row_number().over(w)).withColumn("after", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before, cell = F.col("after") - F.col("tokens"), F.floor((F.col("after") - F.col("tokens")) / stride)
    turns = turns.withColumn("before", before).withColumn("cell", cell).withColumn("crosses", F.floor((F.col("after") - 1) / stride) > F.col("cell"))
    opens = (F.col("pos") == 1) | F.col("crosses") | F.lag("crosses", 1, False).over(w) | (F.col("cell") != F.lag("cell", 1, -1).over(w))
    turns = turns.withColumn("opens", opens).withColumn("window", F.sum(F.col("opens").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)

    # The block that follows each block, and whether the block opens its conversation.
    by_block = Window.partitionBy("conv_id").orderBy("block")
    blocks = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("all_tokens"))
    blocks = blocks.select(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), "rows", "all_tokens", F.lead("block").over(by_block).alias("next_block"), (F.row_number().over(by_block) == 1).alias("is_first"))
    turns = turns.join(blocks, turns["conv_id"].eqNullSafe(F.col("b_conv")) & (turns["block"] == F.col("b_block"))).drop("b_conv", "b_block")

    member = lambda blk, win, context: F.struct(blk.alias("block"), win.cast("long").alias("window"), F.lit(context).alias("context"))
    is_system = (F.col("role") == "system") & F.col("is_first") & (F.col("pos") == 1)
    members = [member(F.col("block"), F.col("window"), False)]
    for j in range(1, history + 1):
        near = F.lead("opens", j, False).over(w) & (F.lead("before", j).over(w) - F.col("before") <= history_tokens)
        members.append(F.when(near & ~is_system, member(F.col("block"), F.lead("window", j).over(w), True)))
    at_end = (F.col("pos") > F.col("rows") - history) & (F.col("all_tokens") - F.col("before") <= history_tokens)
    members.append(F.when(at_end & F.col("next_block").isNotNull() & ~is_system, member(F.col("next_block"), F.lit(0), True)))
    placed = turns.select("conv_id", F.col("block").alias("src_block"), "pos", "role", "text", "tokens", is_system.alias("is_system"), F.col("opens"), F.array_compact(F.array(*members)).alias("to"))

    # The system turn also goes to every other window of its conversation.
    system = placed.where("is_system").select(F.col("conv_id").alias("s_conv"), F.col("src_block").alias("s_block"), F.col("pos").alias("s_pos"), "role", "text", "tokens")
    heads = placed.where("opens").select("conv_id", F.col("to")[0].alias("to"))
    later = heads.join(system, heads["conv_id"].eqNullSafe(F.col("s_conv")) & ~((F.col("to.block") == F.col("s_block")) & (F.col("to.window") == 0)))
    later = later.select("conv_id", F.col("s_block").alias("src_block"), F.col("s_pos").alias("pos"), "role", "text", "tokens", F.lit(True).alias("is_system"), "to.block", "to.window", F.lit(True).alias("context"))
    rows = placed.select("conv_id", "src_block", "pos", "role", "text", "tokens", "is_system", F.explode("to").alias("to")).select("conv_id", "src_block", "pos", "role", "text", "tokens", "is_system", "to.block", "to.window", "to.context")
    rows = rows.unionByName(later)

    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n"))).withColumn("order", F.struct((~F.col("is_system")).alias("rest"), "src_block", "pos"))
    in_window = Window.partitionBy("conv_id", "block", "window").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece")).over(in_window), F.lit(0)) + F.length("head")
    rows = rows.withColumn("at", at)
    learnt = (F.col("role") == "assistant") & ~F.col("context")
    span = F.when(learnt, F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("stop")))
    made = rows.groupBy("conv_id", "block", "window").agg(
        F.array_sort(F.collect_list(F.struct("order", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.col("context").cast("long")).alias("n_context"),
        F.sum("tokens").alias("tokens"),
    )
    return made.select("conv_id", "block", "window", F.array_join(F.col("pieces.piece"), "").alias("text"), "loss_spans", "n_turns", "n_context", "tokens", (F.col("tokens") > budget).alias("over_budget"))


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of :func:`format_chat` say, one row per conversation, from their texts and masks alone.

    ``n_windows`` is their number, ``n_context`` that of the turns that they repeat.
    The digests are of one string per conversation; that string is gathered, as a digest needs it.
    """
    pieces = F.split("text", F.lit(r"<\|im_end\|>\n"))
    fresh = F.slice(pieces, F.col("n_context").cast("int") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_context").cast("int"), F.lit(0)))

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(len(START) + 1), cut - len(START) - 1)
        return F.concat(unescape_role(role), F.lit("\n"), unescape(F.substring(piece, cut + 1, F.length(piece))), F.lit("\n"))

    learnt = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    read = windows.select("conv_id", F.size(fresh).cast("long").alias("n"), F.length("text").cast("long").alias("chars"), F.col("n_context").alias("context"), F.struct("block", "window", F.array_join(F.transform(fresh, turn), "").alias("turns"), F.array_join(learnt, "").alias("loss")).alias("part"))
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"), F.sum("context").alias("n_context"), F.array_sort(F.collect_list("part")).alias("parts"))
    whole = whole.select("conv_id", "n_turns", "formatted_chars", "n_windows", "n_context", F.array_join(F.col("parts.turns"), "").alias("turns"), F.array_join(F.col("parts.loss"), "").alias("loss"))
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
        "n_context",
    )
