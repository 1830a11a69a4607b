"""Chat formatting by a declarative template and a finite-state machine over roles.

The template names the marks around each role's turns, the roles whose text is trained on, and
which role may follow which. A conversation becomes a list of segments, each with a loss flag;
joined, they are the formatted text. Control strings inside texts are escaped reversibly: a
backslash goes in after their first character, and one more where there are some already. So a mark
in the output is always the template's own, and the turns can be read back from the output.

A conversation is one row of the result, as a document is of its table; rows are gathered by
conversation and nothing else, and sorted by turn, role and text. Rows that repeat are turns
that repeat. Null text is an empty one, null role the empty name; roles the template doesn't know get
marks that spell the role out, and no loss. Conversations that the machine rejects are formatted
like others and flagged. Turns without conversation id form one conversation. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marks:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Marks]
    follows: dict[str, tuple[str, ...]]  # state (the last role, or "" at the start) -> next roles
    ends: tuple[str, ...]  # roles a conversation may end with
    other: Marks = Marks("[TURN]", "[/TURN]")
    name_end: str = "[AS]"
    control: tuple[str, ...] = field(default=())  # further strings to escape

    def __post_init__(self):
        marks = self.strings()
        if any("\\" in m or len(m) < 2 for m in marks):
            raise ValueError("marks need two characters or more and no backslash")
        for a in marks:
            for b in marks:
                if any(b.startswith(a[i:]) or b in a[i:] for i in range(1, len(a))):
                    raise ValueError(f"a part of {a!r} could be read as {b!r}")

    def strings(self) -> list[str]:
        every = [*self.roles.values(), self.other]
        found = [m for marks in every for m in (marks.open, marks.close)]
        return list(dict.fromkeys([*found, self.name_end, *self.control]))


DEFAULT = Template(
    roles={
        "system": Marks("[SYS]", "[/SYS]"),
        "user": Marks("[INST]", "[/INST]"),
        "assistant": Marks("<s>", "</s>", loss=True),
    },
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)


def _control_pattern(template: Template, extra: str) -> str:
    heads = "".join(dict.fromkeys(re.escape(m[0]) for m in template.strings()))
    tails = "|".join(dict.fromkeys(re.escape(m[1:]) for m in template.strings()))
    return rf"([{heads}]){extra}(\\*)({tails})"


def escape(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, _control_pattern(template, ""), r"$1\\$2$3")


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, _control_pattern(template, r"\\"), "$1$2$3")


def _segment(text: Column, loss: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(loss).alias("loss"))


def _turn_segments(turn: Column, template: Template) -> Column:
    role, body = turn["role"], escape(turn["text"], template)
    name = F.concat(F.lit(template.other.open), escape(role, template), F.lit(template.name_end))
    chosen = F.array(_segment(name, False), _segment(body, False), _segment(F.lit(template.other.close), False))
    for known, marks in template.roles.items():
        chosen = F.when(role == known, F.array(
            _segment(F.lit(marks.open), False), _segment(body, marks.loss), _segment(F.lit(marks.close), False)
        )).otherwise(chosen)
    return chosen


def _machine(roles: Column, template: Template) -> Column:
    """``(state, at, error)``: the last state, the number of turns, and the first turn (from 0)
    that must not follow; nothing follows from there on."""
    allowed = [f"{state}\0{role}" for state, after in template.follows.items() for role in after]
    start = F.struct(
        F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error")
    )

    def step(now: Column, role: Column) -> Column:
        fits = F.coalesce(F.concat(now["state"], F.lit("\0"), role).isin(allowed), F.lit(False))
        return F.struct(
            F.when(fits, role).otherwise(F.lit("\0")).alias("state"),
            (now["at"] + 1).alias("at"),
            F.coalesce(now["error"], F.when(~fits, now["at"])).alias("error"),
        )

    return F.aggregate(roles, start, step)


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """``(conv_id, valid, first_error, segments, formatted)`` of every conversation.

    ``first_error`` is the first turn out of order, or the number of turns if only the end is
    missing; null for a valid conversation. ``segments`` are (text, loss).
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    run = gathered.select(
        "conv_id",
        _machine(F.col("turns.role"), template).alias("run"),
        F.flatten(F.transform("turns", lambda t: _turn_segments(t, template))).alias("segments"),
    )
    ended = F.coalesce(F.col("run.state").isin(*template.ends), F.lit(False))
    return run.select(
        "conv_id",
        (F.col("run.error").isNull() & ended).alias("valid"),
        F.coalesce("run.error", F.when(~ended, F.col("run.at"))).alias("first_error"),
        "segments",
        F.array_join("segments.text", "").alias("formatted"),
    )


def _between(text: Column, marks: Marks) -> Column:
    return F.substring(text, F.lit(len(marks.open) + 1), F.length(text) - len(marks.open) - len(marks.close))


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The (role, text) of all turns, from the formatted text alone."""
    every = [*template.roles.values(), template.other]
    spans = "|".join(f"{re.escape(m.open)}.*?{re.escape(m.close)}" for m in every)

    def turn(span: Column) -> Column:
        inner = _between(span, template.other)
        cut = F.instr(inner, template.name_end)
        found = F.struct(
            unescape(F.substring(inner, F.lit(1), cut - 1), template).alias("role"),
            unescape(F.substring(inner, cut + len(template.name_end), F.length(inner)), template).alias("text"),
        )
        for role, marks in template.roles.items():
            found = F.when(span.startswith(marks.open), F.struct(
                F.lit(role).alias("role"), unescape(_between(span, marks), template).alias("text")
            )).otherwise(found)
        return found

    return F.transform(F.regexp_extract_all(formatted, F.lit(f"(?s){spans}"), F.lit(0)), turn)


def read_loss_text(segments: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    trained = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(trained, lambda s: unescape(s["text"], template)), "")
