"""Operator 6: chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the output: conversation = turn*, turn = START role "\\n" content END "\\n". A deterministic parser
splits at END and the line feed, then at the first line feed of each turn, and undoes the escapes. Each turn
is rendered as it is and reparsed; where the recovered role and text differ from the source, the next level
of escaping is tried until they are identical. Escaping puts a "~" after the "<" of "<|", "<~|", ... so
that escaped text never holds a control string and every escape can be undone; a line feed in a role
becomes a control string of its own. The loss mask has a run for each turn: code points to skip, then to keep.

Defined results: rows of a conversation are ordered by turn, then role and text (null first), repeated
rows are turns of their own; a null role or text is empty; rows with a null conv_id are one conversation; an
empty table gives no conversation; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
ESCAPE, UNESCAPE = (r"<(~*)\|", "<~$1|"), (r"<~(~*)\|", "<$1|")
LEVELS = 2


def escaped(text: Column, level: int) -> Column:
    return text if level == 0 else F.regexp_replace(text, *map(F.lit, ESCAPE))


def escaped_role(role: Column, level: int) -> Column:
    return role if level == 0 else F.replace(escaped(role, level), F.lit("\n"), F.lit(BREAK))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, *map(F.lit, UNESCAPE))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(BREAK), F.lit("\n")))


def rendered(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(START), escaped_role(role, level), F.lit("\n"), escaped(text, level), F.lit(END + "\n"))


def turns_of(formatted: Column) -> Column:
    """The turns as written: whatever stands before each END and line feed."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def head_of(turn: Column) -> Column:
    """The written role: from START to the first line feed."""
    return F.substring_index(F.substr(turn, F.lit(len(START) + 1)), "\n", 1)


def parsed(turn: Column) -> Column:
    head = head_of(turn)
    body = F.substr(turn, F.char_length(head) + F.lit(len(START) + 2))
    return F.struct(unescaped_role(head).alias("role"), unescaped(body).alias("text"))


def survives(role: Column, text: Column, level: int) -> Column:
    """Whether the parser finds exactly this turn in its rendering."""
    found = F.transform(turns_of(rendered(role, text, level)), parsed)
    return F.to_json(found) == F.to_json(F.array(F.struct(role.alias("role"), text.alias("text"))))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask array<struct<skip, keep>> (a run for each turn), escaped_turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    role, text = F.col("role"), F.col("text")
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(survives(role, text, k), F.lit(k)).otherwise(level)
    rows = rows.withColumn("level", level)
    pick = lambda f: F.when(F.col("level") == 0, f(0)).otherwise(f(1))
    skip = F.char_length(pick(lambda k: escaped_role(role, k))) + F.lit(len(START) + 1)
    keep = F.when(role == "assistant", F.char_length(pick(lambda k: escaped(text, k)))).otherwise(F.lit(0))
    rows = rows.select("conv_id", F.struct("turn", "role", "text", pick(lambda k: rendered(role, text, k)).alias("written"), skip.cast("int").alias("skip"), keep.cast("int").alias("keep"), "level").alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select(
        "conv_id",
        F.array_join("t.written", "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["skip"].alias("skip"), x["keep"].alias("keep"))).alias("loss_mask"),
        F.size(F.filter("t", lambda x: x["level"] > 0)).alias("escaped_turns"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text and formatted_chars, from the written text and its mask alone."""
    pieces = formatted.select("*", turns_of(F.col("formatted")).alias("pieces"))
    kept = F.zip_with("pieces", "loss_mask", lambda p, m: unescaped(F.substr(p, m["skip"] + 1, m["keep"])))
    return pieces.select(
        "conv_id",
        F.transform("pieces", parsed).alias("turns"),
        F.array_join(kept, "").alias("loss_text"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        *[c for c in formatted.columns if c not in ("conv_id",)],
    )


def verified(back: DataFrame) -> DataFrame:
    """Fails if any conversation does not come back as its source."""
    same = F.to_json("turns") == F.to_json("source")
    return back.withColumn("turns", F.when(same, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation did not survive formatting"))))


def digests(conversations: DataFrame) -> DataFrame:
    back = verified(read_back(format_conversations(conversations)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
