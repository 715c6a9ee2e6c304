"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it are its context, only its reply is trainable.
Turns after the last assistant turn form one example without a target, so no turn is lost.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles a backslash is doubled
and ``<|`` becomes ``<\\|``, so a control string in a text can neither open nor close a turn; in roles a line
break becomes ``\\n``. ``unescape_text`` is the exact inverse.

Defined results: a null text or role is empty; a null turn number sorts first; equal turn numbers are ordered by role, then
text; repeated rows are repeated turns; a null conversation id is a conversation of its own; an empty table gives no
example. Other columns of the input are ignored, whatever their names. A conversation is one row while it is formatted,
as its examples are; rows of a conversation meet after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharegate.llm.common import quoted

START, END, ASSISTANT = "<|im_start|>", "<|im_end|>", "assistant"


def escape_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape_text(c: Column) -> Column:
    """An odd backslash before ``|`` is ours, as backslashes of the text are doubled."""
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape_text(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape_text(F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape_text(text), F.lit(END + "\n"))


def format_chat(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: conv_id, example (from 0), prompt, target (null without one), loss_start (first trainable
    character of prompt || target, from 0) and loss_end. The prompt ends with the opening of the reply; the target is
    the escaped reply with its end mark, and the trainable part is the reply without the mark."""
    rows = conversations.select(
        F.col(quoted(conv_id)).alias("conv_id"), F.col(quoted(turn)).alias("turn"),
        F.coalesce(F.col(quoted(role)).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rendered = turns.select("conv_id", "turns", F.transform("turns", lambda t: render(t["role"], t["text"])).alias("_r"))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get("turns", i - 1)["role"] == ASSISTANT) | (i == n))
    at = rendered.select("conv_id", "turns", "_r", F.posexplode(ends).alias("example", "_k"))
    last = F.get("turns", F.col("_k") - 1)
    trained = last["role"] == ASSISTANT
    before = F.array_join(F.slice("_r", F.lit(1), F.when(trained, F.col("_k") - 1).otherwise(F.col("_k"))), "")
    prompt = F.when(trained, F.concat(before, F.lit(f"{START}{ASSISTANT}\n"))).otherwise(before)
    target = F.when(trained, F.concat(escape_text(last["text"]), F.lit(END + "\n")))
    made = at.select("conv_id", "example", prompt.alias("prompt"), target.alias("target"))
    start = F.length("prompt").cast("long")
    return made.select("*", start.alias("loss_start"),
                       (start + F.coalesce(F.length("target") - len(END) - 1, F.lit(0))).alias("loss_end"))


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted string."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|im_start\|>", -1)) - 1, F.lit(0)))
    return F.transform(parts, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape_text(F.substring_index(F.substr(p, F.instr(p, F.lit("\n")) + 1), END, 1)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: the turns of the last (longest) one and the texts under the loss mask
    of all. formatted_chars adds up prompt and target of every example."""
    whole = F.concat("prompt", F.coalesce("target", F.lit("")))
    masked = F.substr(whole, F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    parts = examples.select("conv_id", "example", whole.alias("_whole"), unescape_text(masked).alias("_loss"))
    per = parts.groupBy("conv_id").agg(
        F.max_by("_whole", "example").alias("_last"), F.sum(F.length("_whole")).cast("long").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "_loss"))), lambda x: x["_loss"]), "").alias("_loss"))
    turns = per.select("conv_id", "formatted_chars", "_loss", parse_turns(F.col("_last")).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
                        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
