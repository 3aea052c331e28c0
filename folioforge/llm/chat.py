"""Chat formatting: a finite-state machine over roles and a declarative template.

A template says how each role's turn is opened and closed and whether its text is trained
on.  The machine reads a conversation's roles in order and tells whether they form a legal
sequence.  Texts are escaped, so that no control string of the template can occur inside
one; the escape is undone exactly on reading.  All of it is DataFrame expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RoleMarks:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Marks per role, legal transitions between roles and the states a chat may end in.

    ``others`` marks turns of any role not named; the role's name stands between its
    opening and ``name_end``.  ``escape`` must occur in no mark.
    """

    roles: dict[str, RoleMarks] = field(
        default_factory=lambda: {
            "system": RoleMarks("[SYS] ", " [/SYS]\n"),
            "user": RoleMarks("[INST] ", " [/INST]\n"),
            "assistant": RoleMarks("[OUT] ", " </s>\n", loss=True),
            "tool": RoleMarks("[TOOL] ", " [/TOOL]\n"),
        }
    )
    others: RoleMarks = RoleMarks("[ROLE] ", " [/ROLE]\n")
    name_end: str = " [NAME] "
    escape: str = "\\"
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    accepting: tuple[str, ...] = ("assistant",)

    def control_strings(self) -> list[str]:
        marks = [m for r in (*self.roles.values(), self.others) for m in (r.opening, r.closing)] + [self.name_end]
        return sorted({m.strip() for m in marks})

    def __post_init__(self):
        found = self.control_strings()
        if any(self.escape in m for m in found) or len(found) > 26 or len(self.escape) != 1:
            raise ValueError("the escape is one character that no mark holds; at most 26 marks")
        if any(a != b and a in b for a in found for b in found):
            raise ValueError("no mark may hold another")


def escape_text(text: Column, template: ChatTemplate) -> Column:
    """Reversible: escapes the escape, then names each control string by a letter."""
    out = F.replace(text, F.lit(template.escape), F.lit(template.escape + "0"))
    for i, mark in enumerate(template.control_strings()):
        out = F.replace(out, F.lit(mark), F.lit(template.escape + chr(97 + i)))
    return out


def unescape_text(text: Column, template: ChatTemplate) -> Column:
    out = text
    for i, mark in enumerate(template.control_strings()):
        out = F.replace(out, F.lit(template.escape + chr(97 + i)), F.lit(mark))
    return F.replace(out, F.lit(template.escape + "0"), F.lit(template.escape))


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: conv_id, segments, valid, first_bad_turn.

    ``turns`` has conv_id, turn, role and text.  Turns go by number, then role and text;
    repeated rows stay.  Null role and text are empty; rows with null conv_id are one
    conversation.  ``segments`` is an array of (text, loss): opening, escaped text and
    closing of each turn.  ``first_bad_turn`` is the place, from 0, at which the machine
    finds no transition, or the number of turns if the chat ends in the wrong state; such
    chats are formatted all the same, with ``valid`` false.  A conversation is one row, as
    its text is one string.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    slim = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), escape_text(text, template).alias("text")).alias("t"))
    chats = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def marks(of: Column, which: str) -> Column:
        out = F.when(F.lit(False), F.lit(None))
        for name, m in template.roles.items():
            out = out.when(of == name, F.lit(getattr(m, which)))
        if which == "opening":
            return out.otherwise(F.concat(F.lit(template.others.opening), escape_text(of, template), F.lit(template.name_end)))
        return out.otherwise(F.lit(getattr(template.others, which)))

    def parts(t: Column) -> Column:
        def one(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        return F.array(one(marks(t["role"], "opening"), F.lit(False)), one(t["text"], marks(t["role"], "loss")), one(marks(t["role"], "closing"), F.lit(False)))

    moves = F.create_map(*[F.lit(x) for a, following in template.transitions.items() for b in following for x in (f"{a}>{b}", b)])

    def machine(acc: Column, t: Column) -> Column:
        new = F.try_element_at(moves, F.concat(acc["state"], F.lit(">"), t["role"]))
        ok = acc["bad"].isNull() & new.isNotNull()
        return F.struct(F.when(ok, new).otherwise(acc["state"]).alias("state"), F.when(ok | acc["bad"].isNotNull(), acc["bad"]).otherwise(acc["at"]).alias("bad"), (acc["at"] + 1).alias("at"))

    begin = F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("at"))
    run = F.aggregate("turns", begin, machine)
    out = chats.select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"), run.alias("run"))
    bad = F.coalesce(F.col("run.bad"), F.when(~F.col("run.state").isin(*template.accepting), F.col("run.at")))
    return out.select("conv_id", "segments", bad.isNull().alias("valid"), bad.alias("first_bad_turn"))


def read_conversations(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Parse ``format_conversations`` back: adds ``formatted`` and ``turns`` (role, text)."""

    def quoted(s: str) -> str:
        return re.sub(r"([\[\]()\\.*+?^$|{}/])", r"\\\1", s)

    shapes = [f"{quoted(m.opening)}(?:.*?){quoted(m.closing)}" for m in (*template.roles.values(), template.others)]
    whole = formatted.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))

    def inside(m: Column, marks: RoleMarks) -> Column:
        return F.substr(m, F.lit(len(marks.opening) + 1), F.length(m) - len(marks.opening) - len(marks.closing))

    def parse(m: Column) -> Column:
        role, text = F.when(F.lit(False), F.lit(None)), F.when(F.lit(False), F.lit(None))
        for name, marks in template.roles.items():
            role = role.when(F.startswith(m, F.lit(marks.opening)), F.lit(name))
            text = text.when(F.startswith(m, F.lit(marks.opening)), inside(m, marks))
        rest = inside(m, template.others)
        at = F.locate(template.name_end, rest)
        role = role.otherwise(unescape_text(F.substr(rest, F.lit(1), at - 1), template))
        text = text.otherwise(F.substr(rest, at + len(template.name_end)))
        return F.struct(role.alias("role"), unescape_text(text, template).alias("text"))

    found = F.regexp_extract_all("formatted", F.lit("(?s)(?:" + "|".join(shapes) + ")"), F.lit(0))
    return whole.withColumn("turns", F.transform(found, parse))


def conversation_digests(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, first_bad_turn."""
    back = read_conversations(formatted, template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape_text(s["text"], template)), "")
    out = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), trained.alias("trained"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "first_bad_turn")
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars", "valid", "first_bad_turn")
