"""Chat formatting in DataFrame expressions: sort collected turn structs, merge neighbours of one role by array functions, concatenate.

Template: a user's block is ``[INST]`` body ``[/INST]``, an assistant's ``<s>`` body ``</s>``, any other role's ``[ROLE]`` role ``[/ROLE]``
body ``[END]``; the turns merged into a body are parted by ``[NEXT]``. A control string inside a text or role gets a backslash after
its first character, one more than it may have there already, so what is written can be read back exactly.
The output keeps a conversation as segments with a loss flag; their concatenation is the formatted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(/?(?:s>|INST\]|ROLE\]|END\]|NEXT\]))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){CONTROL}", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){CONTROL}", r"$1$2$3")


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, segments array<struct<text, loss>>): one row for each conversation.

    Turns stand in order of turn, then role, then text (null turns first); null roles and texts count as empty; repeated rows
    are turns of their own; a null id is a conversation like others. Loss is on an assistant's texts alone.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    held = rows.select(F.col(id_col).alias("id"), turn.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # where a block begins: the first turn, and turns whose role isn't that of the turn before
    begins = F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 or turns[i].role <> turns[greatest(i - 1, 0)].role)")
    held = held.select("id", "turns", begins.alias("begins"))
    blocks = F.expr(
        "transform(begins, (b, k) -> struct(turns[b].role as role, transform(slice(turns, b + 1,"
        " coalesce(get(begins, k + 1), size(turns)) - b), t -> t.text) as texts))"
    )
    held = held.select("id", blocks.alias("blocks"))

    def part(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(b: Column) -> Column:
        role, no = b["role"], F.lit(False)
        start = F.when(role == "user", "[INST]").when(role == "assistant", "<s>").otherwise(F.concat(F.lit("[ROLE]"), escaped(role), F.lit("[/ROLE]")))
        end = F.when(role == "user", "[/INST]").when(role == "assistant", "</s>").otherwise("[END]")
        body = F.transform(b["texts"], lambda t, i: F.array(part(F.when(i == 0, start).otherwise("[NEXT]"), no), part(escaped(t), role == "assistant")))
        return F.concat(F.flatten(body), F.array(part(end, no)))

    return held.select(F.col("id").alias(id_col), F.flatten(F.transform("blocks", block)).alias("segments"))


def formatted(segments: str = "segments") -> Column:
    """The formatted text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_chats(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, formatted, turns array<struct<role, text>>, loss): the turns as parsed from the formatted text, and all text under the loss flags."""
    held = chats.select(id_col, formatted().alias("formatted"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "").alias("loss"))
    blocks = F.regexp_extract_all("formatted", F.lit(r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE\].*?\[END\]"), F.lit(0))

    def parsed(b: Column) -> Column:
        user, assistant = b.startswith("[INST]"), b.startswith("<s>")
        role = F.when(user, "user").when(assistant, "assistant").otherwise(unescaped(F.regexp_extract(b, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)))
        body = F.regexp_replace(b, r"^(?:\[INST\]|<s>|(?s:\[ROLE\].*?\[/ROLE\]))|(?:\[/INST\]|</s>|\[END\])$", "")
        return F.transform(F.split(body, r"\[NEXT\]", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    held = held.select(id_col, "formatted", "loss", blocks.alias("blocks"))
    return held.select(id_col, "formatted", F.flatten(F.transform("blocks", parsed)).alias("turns"), "loss")


def digests(read: DataFrame, id_col: str = "conv_id") -> DataFrame:
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
