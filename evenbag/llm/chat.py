r"""Chat formatting: a state machine over roles and a declarative template.

A template names the strings that open a turn, end its role and end its text,
the roles that bear loss, the turns a role may follow, and strings of other
templates that texts must not smuggle in. Inside roles and texts a backslash is
doubled and each control string gets one after its first character. Runs of
backslashes made by doubling are even and an inserted one stands alone, so it is
undone exactly. All of it is DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col


@dataclass(frozen=True)
class Template:
    open: str = "<|turn|>"
    role_end: str = "<|text|>"
    close: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: state -> roles that may come next; a role is the state after it.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepts: tuple[str, ...] = ("assistant",)

    def controls(self) -> tuple[str, ...]:
        return (self.open, self.role_end, self.close, *self.foreign)


TEMPLATE = Template()


def escape(text: Column, t: Template = TEMPLATE) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), t.controls(), text)


def unescape(text: Column, t: Template = TEMPLATE) -> Column:
    text = reduce(lambda x, c: F.replace(x, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c)), reversed(t.controls()), text)
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, t: Template = TEMPLATE, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row per conversation: conv_id, segments (array of text and loss, which
    joined are the formatted text), formatted, valid, error_turn (index of the
    first turn out of order, the number of turns if it ends too early, else null).

    Turns stand by turn number, ties by role and text, null numbers first; repeated
    rows are turns of their own. A null role or text is empty; a null conv_id is a
    conversation of its own. A conversation out of order is formatted all the
    same. Other columns are not read; no rows give none. A conversation is one
    value of the result, so its turns meet in one task and no more do."""
    x = turns.select(
        col(turns, conv_col).cast("long").alias("conv_id"),
        F.struct(col(turns, turn_col).cast("long").alias("turn"), F.coalesce(col(turns, role_col), F.lit("")).alias("role"), F.coalesce(col(turns, text_col), F.lit("")).alias("text")).alias("t"),
    )
    x = x.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    bears = lambda role: role.isin(*t.loss_roles) if t.loss_roles else F.lit(False)
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    one = lambda m: F.array(
        piece(F.concat(F.lit(t.open), escape(m.role, t), F.lit(t.role_end)), F.lit(False)), piece(escape(m.text, t), bears(m.role)), piece(F.lit(t.close), F.lit(False)))
    moves = F.create_map(*(F.lit(v) for s, roles in t.follows.items() for r in roles for v in (f"{s}>{r}", r)))
    # State after each turn; nothing leads on from "error".
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("right"))

    def step(acc, m):
        to = F.coalesce(F.try_element_at(moves, F.concat(acc.state, F.lit(">"), m.role)), F.lit("\x00error"))
        return F.struct(to.alias("state"), (acc.right + F.when(to == "\x00error", 0).otherwise(1)).alias("right"))

    end = F.aggregate("turns", start, step)
    x = x.select("conv_id", F.flatten(F.transform("turns", one)).alias("segments"), end.alias("end"))
    valid = F.col("end.state").isin(*t.accepts)
    return x.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), valid.alias("valid"), F.when(~valid, F.col("end.right").cast("long")).alias("error_turn"))


def read_back(formatted: Column, t: Template = TEMPLATE) -> Column:
    """The turns (role, text) of a formatted text."""
    turns = F.slice(F.split(formatted, F.lit(_quoted(t.open)), -1), 2, 1 << 30)

    def turn(x):
        role, rest = F.split_part(x, F.lit(t.role_end), F.lit(1)), F.split_part(x, F.lit(t.role_end), F.lit(2))
        return F.struct(unescape(role, t).alias("role"), unescape(F.split_part(rest, F.lit(t.close), F.lit(1)), t).alias("text"))

    return F.transform(turns, turn)


def _quoted(s: str) -> str:
    """A pattern for exactly this string."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def digests(formatted: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """What the formatted texts and the loss flags hold, read back from them."""
    turns = F.transform("turns", lambda m: F.concat(m.role, F.lit("\n"), m.text, F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text, t)), "")
    x = formatted.select("*", read_back(F.col("formatted"), t).alias("turns"), loss.alias("loss_text"))
    return x.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "error_turn",
    )
