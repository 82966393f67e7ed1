"""Chat formatting by prefix-target expansion.

A turn is written `<|im_start|>role`, a line feed, its text, `<|im_end|>` and a line feed. Inside roles and
texts a backslash precedes every backslash and goes between `<` and `|`, so no text can hold a control string,
and the change can be undone; a line feed in a role is written as backslash and n.

Every assistant turn becomes an example of its own: all turns before it are context, and its text alone is
trainable. What stands after the last assistant turn becomes an example without a target, so that no turn is
lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
START, STOP = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def unescaped_role(role: Column) -> Column:
    """Undo `escaped_role`: pairs of backslashes are set aside first, so that only an escaping one counts."""
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))), "\\")


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (0, 1, ...), formatted, loss_start and loss_chars (in characters) of each example.

    Turns of a conversation are ordered by number, then role and text; a null role or text is empty; turns
    without a conversation id form one conversation; repeated rows are repeated turns; other columns are not
    read. A conversation is gathered into one row, as its last example holds all of it anyway.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = F.concat(F.lit(START), escaped_role(role), F.lit("\n"), escaped(text), F.lit(STOP + "\n"))
    one = F.struct("turn", role.alias("role"), text.alias("text"), said.alias("said"), F.length(escaped(text)).alias("chars"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    last = F.expr("array_max(transform(turns, (t, i) -> if(t.role = 'assistant', i, -1)))")
    whole = whole.withColumn("ends", F.expr(
        "filter(transform(turns, (t, i) -> if(t.role = 'assistant' or i = size(turns) - 1, i, -1)), i -> i >= 0)"))
    each = whole.withColumn("last", last).select("conv_id", "turns", "last", F.posexplode("ends").alias("example", "end"))
    said = F.array_join(F.transform(F.slice("turns", 1, F.col("end") + 1), lambda t: t["said"]), "")
    target = F.element_at("turns", F.col("end") + 1)
    formatted = each.select("conv_id", "example", said.alias("formatted"), target.alias("target"), (F.col("end") > F.col("last")).alias("tail"))
    chars = F.when(F.col("tail"), 0).otherwise(F.col("target.chars")).cast("bigint")
    start = F.length("formatted") - len(STOP) - 1 - F.col("target.chars")
    return formatted.select("conv_id", "example", "formatted",
                            F.when(F.col("tail"), F.length("formatted")).otherwise(start).cast("bigint").alias("loss_start"),
                            chars.alias("loss_chars"))


def parsed(formatted: Column) -> Column:
    """The turns (role, text) that a formatted example holds."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescaped_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescaped(F.substring(p, F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - len(STOP) - 1)).alias("text")))


def digests(found: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars (of all examples together)."""
    target = unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars")))
    each = found.select("conv_id", "example", "formatted", target.alias("loss"))
    whole = each.groupBy("conv_id").agg(
        F.max(F.struct("example", "formatted"))["formatted"].alias("formatted"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"))
    turns = parsed(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size(turns).cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"))
