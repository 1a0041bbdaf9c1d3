"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens choose turn-aligned spans: with room = (budget - system turn - history) / 2, turns whose prefix
begins in the same multiple of room form a window, so a window of turns up to room each holds less than twice room; a turn
above room stands alone (and is the only case in which a window may pass the budget: no turn is cut). Every window begins
with the conversation's system turn, then repeats the turns that end the window before it, up to history tokens; both are
masked there. The loss mask covers each assistant turn in the one window in which it is new.

Template: <s>, then per turn [INST]role[/INST]text</s>. In roles and texts & < [ are written &amp; &lt; &#91;, so no control
string can arise in them and unescape() gives them back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OPEN, ROLE, TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"


def _swap(x: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape(x: Column) -> Column:
    return _swap(x, [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")])


def unescape(x: Column) -> Column:
    return _swap(x, [("&#91;", "["), ("&lt;", "<"), ("&amp;", "&")])


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, and 4 for the markers."""
    return (F.ceil(F.char_length(text) / 4) + 4).cast("long")


def chat_windows(turns: DataFrame, budget: int = 2048, history: int = 256, tokens: Column | None = None) -> DataFrame:
    """conv_id, window, text, n_context (leading masked turns), loss_spans (start, end in characters of text), n_tokens.

    turns: conv_id, turn, role, text, a row per turn; tokens: a turn's token count (default: estimated_tokens of its text).
    Turns are ordered by turn, then role, text; repeated rows are turns of their own. Null role or text: empty. Null conv_id:
    one conversation of its own; null turn: first. The system turn is a first turn whose role is system. An empty table gives
    no rows; other columns are not read.
    """
    by = W.partitionBy("conv_id")
    order = by.orderBy("turn", "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *([tokens.cast("long").alias("tokens")] if tokens is not None else []))
    if tokens is None:
        t = t.withColumn("tokens", estimated_tokens(F.col("text")))
    t = t.withColumn("n", F.row_number().over(order))
    t = t.withColumn("sys", (F.col("n") == 1) & (F.col("role") == "system"))
    own = F.when(F.col("sys"), F.lit(0)).otherwise(F.col("tokens"))
    t = t.withColumn("room", F.greatest(F.lit(1).cast("long"), F.floor((budget - history - F.first(F.when(F.col("sys"), F.col("tokens")).otherwise(0)).over(so_far)) / 2)))
    t = t.withColumn("end", F.sum(own).over(so_far)).withColumn("start", F.col("end") - own)
    over = (own > F.col("room")).cast("int")
    t = t.withColumn("cell", F.struct((2 * F.sum(over).over(so_far) - over).alias("a"), F.floor(F.col("start") / F.col("room")).alias("b")))
    # A change of cell begins a window; the system turn goes with the turn after it.
    first = F.lag("cell").over(order).isNull() | F.lag("sys").over(order)
    t = t.withColumn("window", F.sum(F.when(first | (F.lag("cell").over(order) == F.col("cell")), 0).otherwise(1)).over(so_far))
    t = t.withColumn("last", F.max("window").over(by)).withColumn("window_end", F.max("end").over(W.partitionBy("conv_id", "window")))
    here = lambda w, context: F.struct(w.cast("long").alias("window"), context.alias("context"))
    one = here(F.col("window"), F.lit(False))
    tail = (F.col("window") < F.col("last")) & (F.col("window_end") - F.col("start") <= history)
    copies = (
        F.when(F.col("sys"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda w: here(w, w > 0)))
        .when(tail, F.array(one, here(F.col("window") + 1, F.lit(True))))
        .otherwise(F.array(one))
    )
    t = t.select("conv_id", "n", "role", "text", "tokens", F.inline(copies))
    t = t.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("n", "context", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("target")))).alias("turns"),
        F.sum("tokens").alias("n_tokens"),
    )
    head = lambda x: F.char_length(x["role"]) + len(ROLE + TEXT)
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(len(OPEN)).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + head(x) + F.char_length(x["text"]) + len(CLOSE)).alias("at"),
            F.when(x["target"] & ~x["context"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + head(x)).alias("start"), (acc["at"] + head(x) + F.char_length(x["text"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    text = F.concat(F.lit(OPEN), F.array_join(F.transform("turns", lambda x: F.concat(F.lit(ROLE), x["role"], F.lit(TEXT), x["text"], F.lit(CLOSE))), ""))
    return t.select("conv_id", "window", text.alias("text"), F.size(F.filter("turns", lambda x: x["context"])).alias("n_context"), spans.alias("loss_spans"), "n_tokens")


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted window, unescaped."""
    bodies = F.split(F.substr(text, F.lit(len(OPEN) + 1)), r"</s>")
    bodies = F.slice(bodies, F.lit(1), F.size(bodies) - 1)
    role = lambda b: F.substring_index(b, TEXT, 1)
    return F.transform(bodies, lambda b: F.struct(unescape(F.substr(role(b), F.lit(len(ROLE) + 1))).alias("role"), unescape(F.substr(b, F.char_length(role(b)) + len(TEXT) + 1)).alias("text")))


def read_loss(text: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, s["start"] + 1, s["end"] - s["start"]))), "")


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = read_turns(F.col("text"))
    w = windows.select("conv_id", "window", F.slice(turns, F.col("n_context") + 1, F.size(turns)).alias("new"), read_loss(F.col("text"), F.col("loss_spans")).alias("loss"), F.char_length("text").cast("long").alias("chars"))
    w = w.select("conv_id", "window", F.size("new").cast("long").alias("n"), F.array_join(F.transform("new", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"), "loss", "chars")
    w = w.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("all"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join("all.loss", "")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return w.select("conv_id", "n_turns", sha(F.array_join("all.said", "")).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"), "formatted_chars")
