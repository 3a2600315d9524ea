"""Chat formatting by a finite-state machine over roles, in DataFrame functions alone.

A template says how a turn is marked, which roles there are, which may follow which, and which are
learned from.  The machine walks the turns of a conversation once, from the state ``start``: a turn is
allowed if its role may follow the state, and a conversation is valid if all turns are and it ends in a
final state.  Output is the formatted text and the segments it is made of, each with its loss flag.

Control strings inside texts are escaped by a backslash: ``<|`` becomes ``<\\|``, ``<\\|`` becomes
``<\\\\|`` and so on, so no text can open or close a turn and unescaping gives every text back.
Roles other than plain names are URL-encoded.

Edge cases: null text and null role are empty.  Rows are ordered by turn, then role, then text, with
nulls last; repeated rows are turns of their own.  A row without a conversation id is a conversation
of its own, as nothing bounds how many there are.  Invalid conversations are formatted as well and marked.  Extra columns are ignored; an empty table gives an empty result.
A conversation, however long, is one row of the result and so one value in one task; very long texts are formatted whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """before_role, after_role and after_text mark a turn; after_text must hold a ``<|``."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def coded_role(role: Column) -> Column:
    return F.when(role.rlike(r"\A[A-Za-z0-9_-]*\z"), role).otherwise(F.url_encode(role))


def format_chat(turns: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, valid, formatted, segments array<struct<text, loss>>)."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).isNull().alias("last"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    alone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    grouped = turns.select(F.col(conv_col).alias("conv_id"), alone.alias("alone"), turn.alias("t")).groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def allowed(state: Column, role: Column) -> Column:
        return F.coalesce(*[F.when(state == s, role.isin(*after)) for s, after in template.follows.items()], F.lit(False))

    begin = F.struct(F.lit("start").alias("state"), F.lit(True).alias("ok"))
    step = lambda a, t: F.struct(t["role"].alias("state"), (a["ok"] & allowed(a["state"], t["role"])).alias("ok"))
    valid = F.aggregate("t", begin, step, lambda a: a["ok"] & a["state"].isin(*template.final))

    def pieces(t: Column) -> Column:
        loss = t["role"].isin(*template.loss_roles)
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(template.before_role), coded_role(t["role"]), F.lit(template.after_role))
        return F.array(piece(head, F.lit(False)), piece(escape(t["text"]), loss), piece(F.lit(template.after_text), F.lit(False)))

    out = grouped.select("conv_id", F.size("t").cast("long").alias("n_turns"), valid.alias("valid"), F.flatten(F.transform("t", pieces)).alias("segments"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", "n_turns", "valid", formatted.alias("formatted"), "segments")


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """The turns array<struct<role, text>> of a formatted conversation."""
    quoted = "".join(f"\\x{{{ord(c):x}}}" for c in template.after_text)
    turns = F.filter(F.split(formatted, quoted, -1), lambda x: F.startswith(x, F.lit(template.before_role)))

    def turn(x: Column) -> Column:
        rest = F.substr(x, F.lit(len(template.before_role) + 1))
        name = F.substring_index(rest, template.after_role, 1)
        text = F.substr(rest, F.length(name) + F.lit(len(template.after_role) + 1))
        return F.struct(F.url_decode(name).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments: Column) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid) read from the output."""
    read = chats.select("conv_id", "valid", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid")
