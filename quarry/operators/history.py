"""Conversation-history operators over a message table.

Messages: ``(conv_id, turn, role, text[, items, has_function_item, is_summary])``
where ``turn`` orders the messages of a conversation; gaps are allowed.
Per-conversation figures come from hash aggregations (partial combine) and
are joined back on ``conv_id``; no operator sorts a whole conversation in one
window, so a very long conversation is split by adaptive skew-join handling
instead of landing in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMMARY_KEY = "__summary__"  # fixed value: metadata key marking a summary message


# The kinds of message items that call a function or hold its result.
FUNCTION_KINDS = ("FunctionCallContent", "FunctionResultContent")


def has_function_item(items: str | Column) -> Column:
    """Whether any of a message's ``items`` (structs with a ``kind``) calls a function or
    holds a function's result; false for no items."""
    items = F.col(items) if isinstance(items, str) else items
    return F.coalesce(F.exists(items, lambda i: F.coalesce(i["kind"].isin(*FUNCTION_KINDS), F.lit(False))), F.lit(False))


def with_defaults(messages: DataFrame) -> DataFrame:
    out = messages
    if "has_function_item" not in out.columns:
        out = out.withColumn("has_function_item", has_function_item("items") if "items" in out.columns else F.lit(False))
    if "is_summary" not in out.columns:
        out = out.withColumn("is_summary", F.lit(False))
    return out


def clean_history(messages: DataFrame) -> DataFrame:
    """Drop messages whose text is NULL or only whitespace."""
    return messages.where(F.col("text").rlike(r"(?U)\S"))


def conversation_stats(messages: DataFrame) -> DataFrame:
    """``(conv_id, n, first_system, first_plain, insertion)``: the message count, the turns
    of the first system and the first non-summary message, and how many messages stand
    before the latter (all, if every message is a summary)."""
    m = with_defaults(messages)
    st = m.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("role") == "system", F.col("turn"))).alias("first_system"),
        F.min(F.when(~F.col("is_summary"), F.col("turn"))).alias("first_plain"))
    before = (m.where("is_summary").join(st.select("conv_id", "first_plain"), "conv_id")
              .where(F.col("first_plain").isNull() | (F.col("turn") < F.col("first_plain")))
              .groupBy("conv_id").agg(F.count(F.lit(1)).alias("insertion")))
    return st.join(before, "conv_id", "left").fillna(0, ["insertion"])


def _from_end(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages with ``from_end`` (1 for the last); Spark keeps at most
    ``n`` rows per conversation and task (``WindowGroupLimit``)."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= n)


def history_tail(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of every conversation, whatever gaps ``turn`` has."""
    return _from_end(messages, n).drop("from_end")


def reduction_points(messages: DataFrame, target: int, threshold: int = 0) -> DataFrame:
    """Per conversation ``(conv_id, n, first_system, first_plain, truncation)``;
    ``truncation`` is the turn of the first message of the kept tail, NULL when the
    history is too short to reduce.

    Positions count the messages present, so gaps in ``turn`` (left by cleaning) do not
    matter.  The target shrinks by one when a system message exists; nothing is cut
    when ``n - threshold - target <= insertion``; the cut starts at
    ``n - target``, moves back over function messages, and prefers the latest
    user message not before ``n - threshold - target``."""
    if target <= 0 or threshold < 0:
        raise ValueError("target must be > 0 and threshold >= 0")
    m = with_defaults(messages)
    t = F.lit(target) - F.when(F.col("first_system").isNotNull(), 1).otherwise(0)
    st = conversation_stats(m).withColumn("t", t).where(F.col("n") - threshold - F.col("t") > F.col("insertion"))
    # the two positions are among the last target + threshold messages
    ends = _from_end(m.select("conv_id", "turn"), target + threshold).join(st.select("conv_id", "t"), "conv_id")
    marks = ends.groupBy("conv_id").agg(
        F.max(F.when(F.col("from_end") == F.greatest(F.col("t"), F.lit(1)), F.col("turn"))).alias("start"),
        F.max(F.when(F.col("from_end") == F.greatest(F.col("t") + threshold, F.lit(1)), F.col("turn"))).alias("earliest"))
    plain = ~F.col("has_function_item") & (F.col("turn") <= F.col("start"))
    cut = m.join(marks, "conv_id").groupBy("conv_id").agg(
        F.max(F.when(plain, F.col("turn"))).alias("target_turn"),
        F.max(F.when(plain & (F.col("role") == "user") & (F.col("turn") >= F.col("earliest")), F.col("turn"))
              ).alias("user_turn"))
    all_stats = conversation_stats(m).select("conv_id", "n", "first_system", "first_plain")
    return all_stats.join(cut, "conv_id", "left").select(
        "conv_id", "n", "first_system", "first_plain", F.coalesce("user_turn", "target_turn").alias("truncation"))


def reduce_history(messages: DataFrame, target: int, threshold: int = 0,
                   summary_count: int = 1) -> DataFrame:
    """Reduced conversations ``(conv_id, out_pos, turn, role, kind, text)``.

    Order: first system message, earlier summaries (multi-summary mode), the
    new summary slot (``kind='summary'``, ``turn``/``text`` NULL - the text is
    produced by a model outside this job), preserved function messages of
    ``[insertion, truncation)``, then the tail ``[truncation, n)``.
    Conversations too short to reduce keep every message (``kind='kept'``)."""
    single = summary_count == 1
    m = with_defaults(messages)
    pts = reduction_points(m, target, threshold)
    j = m.join(pts, "conv_id")
    red = F.col("truncation").isNotNull()
    turn = F.col("turn")
    kind = (F.when(~red, F.lit("kept"))
            .when(turn == F.col("first_system"), F.lit("system"))
            .when(F.lit(not single) & F.coalesce(turn < F.col("first_plain"), F.lit(True)),
                  F.lit("summary_prior"))
            .when((turn >= F.col("first_plain")) & (turn < F.col("truncation")) & F.col("has_function_item"),
                  F.lit("function"))
            .when(turn >= F.col("truncation"), F.lit("tail")))
    group = (F.when(F.col("kind") == "system", 0).when(F.col("kind") == "summary_prior", 1)
             .when(F.col("kind") == "function", 3).otherwise(4))
    rows = (j.withColumn("kind", kind).where(F.col("kind").isNotNull())
            .select("conv_id", group.alias("g"), "turn", "role", "kind", "text"))
    slots = (pts.where(F.col("truncation").isNotNull())
             .select("conv_id", F.lit(2).alias("g"), F.lit(None).cast(m.schema["turn"].dataType).alias("turn"),
                     F.lit("assistant").alias("role"), F.lit("summary").alias("kind"),
                     F.lit(None).cast("string").alias("text")))
    allrows = rows.unionByName(slots)
    # The output of a reduced conversation is bounded by target + threshold plus
    # its preserved function messages, and a conversation that is not reduced
    # is itself that short, so numbering the output rows per conversation is a
    # small window whatever the length of the input history.
    w = Window.partitionBy("conv_id").orderBy("g", "turn")
    return allrows.select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("out_pos"),
                          "turn", "role", "kind", "text")


def summary_input(messages: DataFrame, target: int, threshold: int = 0,
                  summary_count: int = 1) -> DataFrame:
    """Messages handed to the summariser: before the tail, from the first
    non-summary message in multi-summary mode,
    without function messages (half-open: nothing is both summarised and kept)."""
    m = with_defaults(messages)
    pts = reduction_points(m, target, threshold)
    lo = F.lit(True) if summary_count == 1 else F.col("turn") >= F.col("first_plain")
    return (m.join(pts.where(F.col("truncation").isNotNull()), "conv_id")
            .where(lo & (F.col("turn") < F.col("truncation")) & ~F.col("has_function_item"))
            .select("conv_id", "turn", "role", "text"))


def append_turn(messages: DataFrame, turns: DataFrame, order: str | None = None) -> DataFrame:
    """Append ``(conv_id, user_text, assistant_text)`` as two new messages at the end of each
    conversation.  Several exchanges of one conversation follow each other in the order of
    the column ``order`` of ``turns`` (without it, or on ties, of their texts); the window
    holds the new exchanges of one conversation only."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    w = Window.partitionBy("conv_id").orderBy(*([order] if order else []), "user_text", "assistant_text")
    place = turns.withColumn("__place", F.row_number().over(w) - 1)
    t = place.join(last, "conv_id", "left").withColumn(
        "base", F.coalesce(F.col("last") + 1, F.lit(0)) + 2 * F.col("__place"))
    new = t.select("conv_id", F.explode(F.array(
        F.struct(F.col("base").alias("turn"), F.lit("user").alias("role"), F.col("user_text").alias("text")),
        F.struct((F.col("base") + 1).alias("turn"), F.lit("assistant").alias("role"),
                 F.col("assistant_text").alias("text")))).alias("m")).select("conv_id", "m.*")
    return messages.unionByName(new.select(*[F.col(c).cast(messages.schema[c].dataType) for c in messages.columns]),
                                allowMissingColumns=False)
