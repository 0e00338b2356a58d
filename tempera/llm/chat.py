"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Template of a turn: ``### <role>: <text></turn>\\n``. Inside roles and texts ``\\``, ``#`` and
``<`` become ``\\b``, ``\\h`` and ``\\l`` (in roles ``:`` becomes ``\\c`` too), so neither a header
nor an end mark can come from a text, and the original is restored exactly.

Defined cases: a null text or role counts as empty; rows of a conversation are ordered by turn
(null first), ties by role and text; repeated rows are turns of their own; a null ``conv_id`` is a
conversation like any other; an empty table gives no rows; further columns are ignored.
A conversation is one row of strings here, as its formatted form and its hash are by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SEP, END = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
_CODES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
_ROLE_CODES = (*_CODES, (":", "\\c"))


def escape(c: Column, codes=_CODES) -> Column:
    for raw, code in codes:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column, codes=_CODES) -> Column:
    """The backslash's own code comes last: every backslash of an escaped text starts a code."""
    for raw, code in reversed(codes):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def expand_targets(turns: DataFrame) -> DataFrame:
    """One example per assistant turn: ``conv_id, n_turns, upto, trainable, formatted, loss_start,
    loss_length``. ``formatted`` holds the turns 1 to ``upto``; only the ``loss_length`` characters
    from ``loss_start`` (from 0), the escaped reply, are trainable. A conversation that doesn't end
    with an assistant turn gives one further row with all its turns and nothing trainable."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    conversations = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit(HEAD), escape(t["role"], _ROLE_CODES), F.lit(SEP))
    blocks = conversations.select(
        "conv_id",
        F.size("turns").alias("n_turns"),
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))).alias("blocks"),
        F.transform("turns", lambda t: F.length(head(t))).alias("heads"),
        F.filter(
            F.transform("turns", lambda t, i: F.struct((i + 1).alias("upto"), (t["role"] == ASSISTANT).alias("trainable"))),
            lambda x: x["trainable"] | (x["upto"] == F.size("turns")),
        ).alias("targets"),
    )
    examples = blocks.select("conv_id", "n_turns", "blocks", "heads", F.explode("targets").alias("target"))
    upto = F.col("target.upto")
    before = F.array_join(F.slice("blocks", F.lit(1), upto - 1), "")
    block, start = F.element_at("blocks", upto), F.element_at("heads", upto)
    return examples.select(
        "conv_id",
        F.col("n_turns").cast("long"),
        upto.cast("long").alias("upto"),
        F.col("target.trainable").alias("trainable"),
        F.concat(before, block).alias("formatted"),
        (F.length(before) + start).cast("long").alias("loss_start"),
        F.when(F.col("target.trainable"), F.length(block) - start - len(END)).otherwise(0).cast("long").alias("loss_length"),
    )


def masked_text(formatted: Column, start: Column, length: Column) -> Column:
    """The original text under a loss mask."""
    return unescape(F.substring(formatted, start.cast("int") + 1, length.cast("int")))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted example, as ``array<struct<role, text>>``."""
    pieces = F.split(formatted, END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(len(HEAD) + 1)), SEP, 1)
        text = F.substr(piece, F.length(role) + len(HEAD) + len(SEP) + 1)
        return F.struct(unescape(role, _ROLE_CODES).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: the turns from the longest one, the trainable
    texts from each one's mask, the characters of all of them."""
    reply = F.struct("upto", masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("text"))
    read = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "upto").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("trainable"), reply))).alias("replies"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    read = read.withColumn("turns", parse_turns(F.col("longest")))
    loss = F.array_join(F.transform("replies", lambda r: r["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256
        ).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
