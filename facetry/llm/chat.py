"""Chat formatting with DataFrame functions only: a state machine over roles, and text segments with loss flags.

A template is data: for each role what stands before and after its text and whether its text is trained on, and which
role may follow which.  Texts are escaped so that no mark of the template can occur inside one, and the escape is undone
when a formatted conversation is read back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open + role + colon, the text, close: one turn.  `loss` names the roles whose text is trained on.

    `follows` maps a state (the role before, "" at the start) to the roles that may come next; `final` are the roles a
    conversation may end with.  Marks: open, close and, behind roles, colon.  The first character of a mark that isn't
    white space is its control character; another character follows it, which isn't a backslash, nor is the first."""

    open: str = "### "
    colon: str = ": "
    close: str = " </turn>\n"
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        for mark in (self.open, self.colon, self.close):
            if len(mark.lstrip()) < 2 or "\\" in mark.lstrip()[:2]:
                raise ValueError(f"{mark!r} has no control character with another one behind it")

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(mark.lstrip()[0] for mark in (self.open, self.close, self.colon)))


def escape(text: Column, template: Template) -> Column:
    """Puts a backslash behind each backslash and each control character.  In a mark something else follows the control
    character, so no mark is left, however often its characters are repeated."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c + "\\"))
    return out


def unescape(text: Column, template: Template) -> Column:
    """Drops the backslash behind each backslash and control character."""
    own = "".join("\\" + c for c in ("\\", *template.controls))
    return F.regexp_replace(text, rf"([{own}])\\", "$1")


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, valid, segments, formatted) for each conversation of `turns` (conv_id, turn, role, text).

    segments: array of (text, role, loss) in order; formatted is their text joined.  valid tells whether the roles obey
    the template's state machine; conversations that don't are formatted all the same.  Null roles and texts are empty,
    null turns come first, equal turns are ordered by role and text, repeated rows are repeated turns, null conv_ids
    are one conversation.  Extra columns are ignored, an empty table gives no rows.  A conversation is one value, so its turns meet in one row; its
    size is bounded by what a string can hold (2 GB)."""
    t = template or Template()
    own = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.select("conv_id", own.alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    allowed = F.create_map(*(x for state, to in t.follows.items() for x in (F.lit(state), F.array(*map(F.lit, to)))))
    step = lambda state, x: F.when(F.array_contains(F.coalesce(F.try_element_at(allowed, state), F.array().cast("array<string>")), x["role"]), x["role"])
    ended = F.aggregate("turns", F.lit("").cast("string"), step)

    def cut(x: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(t.open), escape(x["role"], t), F.lit(t.colon)).alias("text"), x["role"].alias("role"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"], t).alias("text"), x["role"].alias("role"), x["role"].isin(*t.loss).alias("loss")),
            F.struct(F.lit(t.close).alias("text"), x["role"].alias("role"), F.lit(False).alias("loss")),
        )

    out = convs.select("conv_id", F.coalesce(ended.isin(*t.final), F.lit(False)).alias("valid"), F.flatten(F.transform("turns", cut)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation: array of (role, text).  Any length of role and text is read: marks are
    found as plain strings, and no expression goes back over what it has read."""
    t = template or Template()
    pieces = F.split(formatted, _quoted(t.close))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        # an escaped role holds no colon mark, so the first one ends it
        at = F.locate(t.colon, p, len(t.open) + 1)
        role, text = p.substr(F.lit(len(t.open) + 1), at - len(t.open) - 1), p.substr(at + len(t.colon), F.length(p))
        return F.struct(unescape(role, t).alias("role"), unescape(text, t).alias("text"))

    return F.transform(pieces, turn)


def _quoted(mark: str) -> str:
    return "".join(c if c.isalnum() or c in " \n#:" else "\\" + c for c in mark)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, segment by segment."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
