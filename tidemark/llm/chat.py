"""Chat formatting in budgeted windows, in DataFrame operations only.

Turn tokens are summed along the conversation.  The running sum cuts it into
cells of the fresh budget: the turns that lie wholly inside a cell make one
window, a turn that crosses a cell's edge makes a window of its own.  So the
choice needs no loop, every window is a span of whole turns, and windows are
independent rows.  A window repeats the leading system turn and the last turns
before its span, as far as the history budget reaches; repeated turns carry no
loss.

    <|im_start|>role\\ntext<|im_end|>\\n
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD

#: The turn markers of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that a turn costs besides its words: markers and role.
TURN_COST = 4
#: Turns per block of the running sum; one block is one window partition.
BLOCK = 4096


def escape(text: Column) -> Column:
    """Put one more backslash between ``<`` and ``|``; no marker survives."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role on one line: backslash and line end become two-letter codes."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def turn_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)) + TURN_COST


def format_windows(turns: DataFrame, budget: int = 512, history: int = 64, system: int = 128) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text).

    Returns one row per window: conv_id, window (ascending in turn order),
    first_turn (ordinal of its first fresh turn), n_turns, n_repeated (leading
    turns that an earlier window holds), tokens, over_budget, formatted, loss
    (array of start and length in code points of the fresh assistant texts, as
    escaped).  A window holds at most ``budget`` tokens unless one turn alone
    has more than ``budget - history - system``, or the system turn more than
    ``system``; ``over_budget`` marks those.  Turns are never cut or dropped.

    Turns are ordered by (turn, role, text), nulls first; rows that tie in all
    three are repeated turns and are all kept.  A null role or text is empty,
    rows with a null conv_id are one conversation.  Other columns are not read.
    The running sum is taken in blocks of the ordinal, so a conversation with a
    large share of all rows is summed by many tasks; numbering its turns is one
    sorted pass that spills.
    """
    fresh = budget - history - system
    if min(fresh, history, system) <= 0:
        raise ValueError("budget must exceed history + system, and both must be positive")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("i", F.row_number().over(order) - 1)
        .withColumn("tokens", turn_tokens(F.col("text")))
        .withColumn("block", F.floor(F.col("i") / BLOCK))
    )
    blocks = t.groupBy("conv_id", "block").agg(F.sum("tokens").alias("own"))
    before = blocks.withColumn(
        "base", F.sum("own").over(Window.partitionBy("conv_id").orderBy("block")) - F.col("own")
    ).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "base")
    t = t.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    inside = Window.partitionBy("conv_id", "block").orderBy("i")
    t = (
        t.withColumn("end", F.col("base") + F.sum("tokens").over(inside))
        .withColumn("start", F.col("end") - F.col("tokens"))
        .withColumn("cell", F.floor(F.col("start") / fresh))
        .withColumn("window", F.col("cell") * 2 + (F.floor((F.col("end") - 1) / fresh) > F.col("cell")).cast("long"))
        .drop("base", "block")
    )
    windows = t.groupBy("conv_id", "window").agg(
        F.min("cell").alias("cell"), F.min("start").alias("w_start"), F.min("i").alias("first_turn")
    )
    lead = t.filter((F.col("i") == 0) & (F.col("role") == "system"))
    # A turn is history of the windows that begin within ``history`` tokens after its
    # start: those of its own cell and of the next ceil(history / fresh) at most.
    past = t.withColumn("at", F.explode(F.sequence("cell", F.floor((F.col("start") + history) / fresh))))
    v = windows.select(
        F.col("conv_id").alias("c"), F.col("window").alias("w"), F.col("cell").alias("at_w"), "w_start", "first_turn"
    )
    repeated = past.join(
        v,
        F.col("conv_id").eqNullSafe(F.col("c"))
        & (F.col("at") == F.col("at_w"))
        & (F.col("w_start") > F.col("start"))
        & (F.col("w_start") <= F.col("start") + history)
        & (F.col("window") < F.col("w"))
        & ~((F.col("i") == 0) & (F.col("role") == "system")),
    )
    systems = lead.join(v, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("first_turn") > F.col("i")))
    cols = ["i", "role", "text", "tokens"]
    members = (
        t.select("conv_id", "window", *cols, F.lit(True).alias("new"))
        .unionByName(repeated.select("conv_id", F.col("w").alias("window"), *cols, F.lit(False).alias("new")))
        .unionByName(systems.select("conv_id", F.col("w").alias("window"), *cols, F.lit(False).alias("new")))
    )
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    pieces = members.select("conv_id", "window", "i", "tokens", "new", "role", head.alias("head"), body.alias("body"))
    made = pieces.groupBy("conv_id", "window").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "i",
                    "new",
                    (F.col("new") & (F.col("role") == "assistant")).alias("loss"),
                    F.char_length("head").alias("n_head"),
                    F.char_length("body").alias("n_body"),
                    F.concat("head", "body", F.lit(END + "\n")).alias("piece"),
                )
            )
        ).alias("p"),
        F.sum("tokens").alias("tokens"),
        F.min(F.when(F.col("new"), F.col("i"))).alias("first_turn"),
    )
    step = len(END) + 1
    spans = F.expr(
        "aggregate(p, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,length:int>>)), (a, x) -> "
        f"named_struct('at', a.at + x.n_head + x.n_body + {step}, 'spans', "
        "if(x.loss, concat(a.spans, array(named_struct('start', a.at + x.n_head, 'length', x.n_body))), a.spans))).spans"
    )
    return made.select(
        "conv_id",
        "window",
        F.col("first_turn").cast("long").alias("first_turn"),
        F.size("p").alias("n_turns"),
        F.size(F.filter("p", lambda x: ~x["new"])).alias("n_repeated"),
        "tokens",
        (F.col("tokens") > budget).alias("over_budget"),
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        spans.alias("loss"),
    )


def parse_window(formatted: Column) -> Column:
    """Turns of a formatted window: array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, F.lit("\n"))
        role = F.substring(p, F.lit(1), at - 1)
        text = F.substring(p, at + 1, F.char_length(p) - at - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def read_back(windows: DataFrame) -> DataFrame:
    """Digest of each conversation, from the windows' formatted text and spans.

    Repeated turns are skipped, so every turn counts once.  A digest is a hash of
    one string and so needs the conversation's text in one row.
    """
    fresh = windows.select(
        "conv_id",
        "window",
        F.slice(parse_window(F.col("formatted")), F.col("n_repeated") + 1, F.col("n_turns")).alias("turns"),
        F.expr("transform(loss, s -> substring(formatted, s.start + 1, s.length))").alias("masked"),
        F.char_length("formatted").alias("chars"),
    )
    parts = fresh.select(
        "conv_id",
        "window",
        F.size("turns").alias("n"),
        F.array_join(
            F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""
        ).alias("all_text"),
        F.array_join(F.transform("masked", unescape), "").alias("loss_text"),
        "chars",
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "all_text", "loss_text"))).alias("p"),
        F.sum("chars").alias("formatted_chars"),
    )
    text = F.array_join(F.transform("p", lambda x: x["all_text"]), "")
    loss = F.array_join(F.transform("p", lambda x: x["loss_text"]), "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
