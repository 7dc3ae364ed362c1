"""Chat formatting from a declarative template, with a loss flag for every segment.

A finite-state machine over roles checks the order of turns.  All of it is DataFrame operations: the turns
of a conversation are sorted into one array, the machine is a fold over it, its transitions a map.

A turn is written ``### role: text</turn>`` and a line feed.  Backslashes in texts are doubled, and control
strings get a backslash behind their first character, so that what is read back is what was written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What opens and closes a turn, what parts role and text, which roles are learned from, and who may follow whom."""

    opening: str = "### "
    between: str = ": "
    closing: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> roles that may come next; the state after a turn is its role, "" is the start.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: States in which a conversation may end.
    ends: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return self.opening, self.closing.rstrip("\n")


CHAT = Template()


def _broken(control: str) -> str:
    return control[0] + "\\" + control[1:]


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in template.controls:
        out = F.replace(out, F.lit(control), F.lit(_broken(control)))
    return out


def unescape(text: Column, template: Template) -> Column:
    out = text
    for control in reversed(template.controls):
        out = F.replace(out, F.lit(_broken(control)), F.lit(control))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column, template: Template) -> Column:
    return F.replace(escape(role, template), F.lit(template.between[0]), F.lit("\\" + template.between[0]))


def _unescape_role(role: Column, template: Template) -> Column:
    return unescape(F.replace(role, F.lit("\\" + template.between[0]), F.lit(template.between[0])), template)


def format_chats(turns: DataFrame, template: Template = CHAT, id_column: str = "conv_id", turn_column: str = "turn",
                 role_column: str = "role", text_column: str = "text") -> DataFrame:
    """``(conv_id, formatted, segments, valid, first_bad)`` for every conversation.

    ``segments`` is an array of (text, loss) whose texts joined are ``formatted``; only texts of the
    template's loss roles carry loss, without the marks around them.  ``first_bad`` is the number (from 0)
    of the first turn that may not stand where it does, or of the end if the last state may not be last;
    ``valid`` is false then.  Turns with equal numbers are ordered by role and text, equal rows are all
    kept; a null role or text is empty, a null turn comes first, a null id is a conversation of its own.
    """
    turn = F.struct(F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), F.lit("")).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ordered = turns.groupBy(F.col(id_column).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    allowed = F.create_map(*[F.lit(x) for state, roles in template.follows.items() for x in (state, "\n".join(["", *roles, ""]))])

    def step(state: Column, one: Column) -> Column:
        may = F.coalesce(F.contains(F.element_at(allowed, state["at"]), F.concat(F.lit("\n"), one["role"], F.lit("\n"))), F.lit(False))
        bad = F.when(state["bad"].isNotNull(), state["bad"]).when(~may | (one["role"] == ""), state["n"])
        return F.struct(one["role"].alias("at"), (state["n"] + 1).alias("n"), bad.alias("bad"))

    start = F.struct(F.lit("").alias("at"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    final = F.aggregate("turns", start, step)
    bad = F.coalesce(F.col("final.bad"), F.when(~F.col("final.at").isin(*template.ends), F.col("final.n")))

    def pieces(one: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(segment(F.concat(F.lit(template.opening), _escape_role(one["role"], template), F.lit(template.between)), F.lit(False)),
                       segment(escape(one["text"], template), one["role"].isin(*template.loss_roles)),
                       segment(F.lit(template.closing), F.lit(False)))

    out = ordered.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"), final.alias("final"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
                      bad.isNull().alias("valid"), bad.alias("first_bad"))


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    parts = F.split(formatted, "\\Q" + template.closing + "\\E")
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def read(one: Column) -> Column:
        body = F.substr(one, F.lit(len(template.opening) + 1))
        # the first separator that no backslash stands before
        role = F.regexp_extract(body, r"^((?:[^\\" + template.between[0] + r"]|\\[\s\S]|" + template.between[0] + "(?!" + template.between[1:] + "))*)", 1)
        text = F.substr(body, F.length(role) + 1 + len(template.between))
        return F.struct(_unescape_role(role, template).alias("role"), unescape(text, template).alias("text"))

    return F.transform(turns, read)
