"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and of the whole
example only that reply's text is trainable.  A conversation that does not end with a reply gives one more
example, all its turns with nothing trainable, so that no turn is lost; ``whole`` marks the one example of each
conversation that holds all of its turns.

The template puts each turn between control strings: OPEN role MIDDLE text CLOSE.  Roles and texts may hold
control strings themselves, these or those of other models: there a backslash goes after the first character
of each, and a backslash of the text is doubled, so none is left, and ``unescaped`` gives back what was there.

All is expressions: a conversation's turns are gathered once, an example is made when its row is asked for (only
its number is exploded, not the texts), and what reads examples by conversation finds them where they lie, without
another shuffle.  An example holds its whole context, so a conversation has to fit a row.

Defined cases: turns are ordered by turn (null first), then role, then text; repeated rows are turns of their own;
null roles and texts are empty; only the role given as ``reply`` is trainable, an empty reply too (a span
of no characters); rows whose conversation is null form one conversation; an empty table gives no examples.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of public chat formats, none of which may stand in a role or text as it is.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")


@dataclass(frozen=True)
class Template:
    """No control string may hold a backslash; each has two characters at least."""

    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    foreign: tuple[str, ...] = FOREIGN

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.middle, self.close, *self.foreign)


def escaped(text: Column, template: Template) -> Column:
    """The text with no control string in it.  Each occurrence is broken, overlapping ones too."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"(?s)(?={'|'.join(re.escape(c) for c in template.controls)})(.)", r"$1\\")


def unescaped(text: Column) -> Column:
    """A backslash before a backslash stands for one; any other was put there."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(rows: DataFrame, template: Template | None = None, reply: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, whole): examples from 0 in the order of their last turns; the characters from
    ``loss_start`` to ``loss_end`` (code points, end exclusive) are trainable, both null where nothing is."""
    template = template or Template()
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    turns = rows.select(F.col(f"`{id_col}`").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).alias("t"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(template.open), escaped(t["role"], template), F.lit(template.middle))
    # Each turn is written once for its conversation; an example joins the first of them.
    written = gathered.select("conv_id", F.transform("turns", lambda t: F.struct((t["role"] == reply).alias("reply"), F.length(head(t)).alias("head"), F.concat(head(t), escaped(t["text"], template), F.lit(template.close)).alias("text"))).alias("turns"))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["reply"] | (i == F.size("turns")))
    each = written.select("conv_id", "turns", F.posexplode(ends).alias("example", "n"))
    last = F.element_at("turns", F.col("n"))
    each = each.select("conv_id", F.col("example").cast("long").alias("example"), F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("n")), lambda t: t["text"]), "").alias("text"), last["reply"].alias("reply"), last["head"].alias("head"), F.length(last["text"]).alias("size"), (F.col("n") == F.size("turns")).alias("whole"))
    begins = F.length("text") - F.col("size") + F.col("head")
    return each.select("conv_id", "example", "text", F.when(F.col("reply"), begins).alias("loss_start"), F.when(F.col("reply"), F.length("text") - len(template.close)).alias("loss_end"), "whole")


def turns_of(text: Column, template: Template | None = None) -> Column:
    """Array of (role, text): the turns that an example holds, as they were before they were formatted."""
    template = template or Template()
    pieces = F.filter(F.split(text, f"{re.escape(template.open)}|{re.escape(template.close)}", -1), lambda p: F.contains(p, F.lit(template.middle)))

    def one(piece: Column) -> Column:
        cut = F.split(piece, re.escape(template.middle), 2)
        return F.struct(unescaped(F.element_at(cut, 1)).alias("role"), unescaped(F.element_at(cut, 2)).alias("text"))

    return F.transform(pieces, one)


def loss_text(examples: DataFrame) -> Column:
    """What is trainable of an example, unescaped; empty where nothing is."""
    span = F.substr(examples["text"], examples["loss_start"] + 1, examples["loss_end"] - examples["loss_start"])
    return F.coalesce(unescaped(span), F.lit(""))
