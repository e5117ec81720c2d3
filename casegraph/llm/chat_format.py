"""Chat formatting: conversations as text segments, each with a flag that says whether it is learnt. DataFrame operations only.

1. A ``Template`` declares, per role, the mark that opens a turn and whether the turn's text is learnt, the
   mark that closes a turn, and a finite-state machine over roles: which role may follow in which state, and in
   which states a conversation may end.
2. Every row becomes three segments: mark, text, mark. Inside texts a control string (the visible part of any
   mark) gets a backslash in front; reading takes one backslash away in front of every control string, so
   any text comes back, also one that has backslashes there already. A role that the template doesn't know is
   written in hexadecimal in a mark of its own.
3. Each role leads to one state, whatever was before (``Template`` checks that), so a turn is judged by its
   predecessor alone. (conversation, turn, role) is counted, range-sorted and written; a turn's predecessor is the row
   before it, or the last row of the sorted part before. No conversation is gathered for that, however long it is.
4. ``format_chat`` returns one row per conversation, with its segments in order. That row holds the whole
   conversation, as a row of ``documents`` holds a whole text; where that is too much, ``chat_segments`` gives
   the same segments as rows (conversation, turn, place), which are never gathered.

Turn order is judged, nothing is repaired or dropped: a conversation that breaks it is formatted as it stands,
with ``valid`` false and the first turn that may not follow in ``broken_at`` (null where only the end is wrong).

Results for odd input: a null text is an empty text; a null role is read as an empty role, which no template knows; a
null conversation id is a conversation of its own; rows stand by turn, null turns first, and of equal turns
by role, then text; repeated rows are turns, each for itself; very long texts are escaped whole; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.llm.common import text_of
from casegraph.scratch import materialize

ESCAPE = "\\"
START = "start"


@dataclass(frozen=True)
class Turn:
    """A role's turns: the opening mark, its control string (what texts must not hold), and whether the text is learnt."""

    control: str
    after: str = " "
    learnt: bool = False

    @property
    def opening(self) -> str:
        return self.control + self.after


@dataclass(frozen=True)
class Template:
    """Marks of turns and the machine over roles.

    ``steps``: (state, role) -> state. A closing mark is ``closing_before`` + ``closing`` + ``closing_after``; ``other`` opens turns of
    roles that ``turns`` lacks, followed by the role in hexadecimal and ``other_after``.
    """

    turns: dict[str, Turn]
    steps: dict[tuple[str, str], str]
    final: frozenset[str]
    closing: str = "</turn>"
    closing_before: str = "\n"
    closing_after: str = "\n"
    other: str = "### Role["
    other_after: str = "]: "
    controls: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        controls = (*[t.control for t in self.turns.values()], self.other, self.closing)
        object.__setattr__(self, "controls", controls)
        after: dict[str, str] = {}
        for (_, role), state in self.steps.items():
            if role not in self.turns or after.setdefault(role, state) != state:
                raise ValueError(f"role {role!r} must be known and lead to one state")
        for a in controls:
            if not a or ESCAPE in a:
                raise ValueError(f"control string {a!r} must not be empty or hold a backslash")
            for b in controls:
                # Otherwise an escape in front of one control string could stand inside another.
                if (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b)) if k < len(a) or a != b):
                    raise ValueError(f"control strings {a!r} and {b!r} overlap")
        if self.closing_before[-1:] in ("", ESCAPE) or any(self.closing_before[0] in c for c in controls):
            raise ValueError("a closing mark starts with a character that is in no control string, and no backslash stands in front of the string")
        for opening in (*[t.opening for t in self.turns.values()], self.other_after):
            if any(opening.endswith(c[:k]) for c in controls for k in range(1, len(c))) or opening.endswith(ESCAPE):
                raise ValueError(f"a text after {opening!r} could complete a control string")


#: system? (user assistant)* user?, with at least one user; only what the assistant says is learnt.
TURNS = Template(
    turns={"system": Turn("### System:"), "user": Turn("### User:"), "assistant": Turn("### Assistant:", learnt=True)},
    steps={
        (START, "system"): "told", (START, "user"): "asked", ("told", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    },
    final=frozenset({"asked", "answered"}),
)


def _any_of(literals: tuple[str, ...]) -> str:
    return "(" + "|".join(rf"\Q{c}\E" for c in literals) + ")"


def escaped(text: Column, template: Template = TURNS) -> Column:
    return F.regexp_replace(text, _any_of(template.controls), r"\\$1")


def unescaped(text: Column, template: Template = TURNS) -> Column:
    return F.regexp_replace(text, r"\\" + _any_of(template.controls), "$1")


def _by_role(role: Column, template: Template, value, otherwise: Column) -> Column:
    chosen = F
    for name, turn in template.turns.items():
        chosen = chosen.when(role == name, F.lit(value(name, turn)))
    return chosen.otherwise(otherwise)


def _rows(chats: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return chats.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("t"))


def _segments(rows: DataFrame, template: Template) -> DataFrame:
    """(conv, turn, role, t, segments): the three segments of every row."""
    other = F.concat(F.lit(template.other), F.hex(F.col("role").cast("binary")), F.lit(template.other_after))
    opening = _by_role(F.col("role"), template, lambda _, turn: turn.opening, other)
    learnt = F.col("role").isin(*[r for r, turn in template.turns.items() if turn.learnt])
    mark = template.closing_before + template.closing + template.closing_after
    pieces = (("opening", opening, F.lit(False)), ("text", escaped(F.col("t"), template), learnt), ("closing", F.lit(mark), F.lit(False)))
    return rows.withColumn("segments", F.array(*[F.struct(F.lit(k).alias("kind"), text.alias("text"), loss.alias("loss")) for k, text, loss in pieces]))


def chat_segments(
    chats: DataFrame, template: Template = TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conversation, turn, role, place, kind, text, loss): the segments as rows, in whatever order the input has."""
    rows = _segments(_rows(chats, conv_col, turn_col, role_col, text_col), template)
    return rows.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.posexplode("segments").alias("place", "s")).select(
        conv_col, turn_col, role_col, "place", "s.*"
    )


def turn_order(
    chats: DataFrame, template: Template = TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role"
) -> DataFrame:
    """(conversation, valid, broken_at): the machine's verdict on every conversation (module docstring, 3)."""
    rows = chats.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"))
    # Rows of one turn and role stand together, so that they are one row with a count from here on.
    runs = rows.groupBy("conv", "turn", "role").agg(F.count(F.lit(1)).alias("copies"))
    ordered = runs.repartitionByRange("conv", "turn", "role").sortWithinPartitions("conv", "turn", "role")
    placed = materialize(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "chat-order")
    # One row a part: its last row, as the part after it sees it.
    ends = placed.groupBy("part").agg(F.max_by(F.struct("conv", "role"), "pos").alias("end"))
    ends = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("end"))
    inside = Window.partitionBy("part").orderBy("pos")
    before = F.coalesce(F.lag(F.struct("conv", "role")).over(inside), F.col("end"))
    seen = placed.join(F.broadcast(ends), "part").withColumn("before", before)
    follows = F.col("before").isNotNull() & F.col("before.conv").eqNullSafe(F.col("conv"))
    after = {role: state for (_, role), state in template.steps.items()}

    def state_of(role: Column) -> Column:
        return reduce(lambda c, item: c.when(role == item[0], item[1]), after.items(), F).otherwise("")

    def may_follow(state: Column) -> Column:
        allowed = [(state == s) & (F.col("role") == r) for s, r in template.steps]
        return reduce(Column.__or__, allowed, F.lit(False))

    state = F.when(follows, state_of(F.col("before.role"))).otherwise(START)
    good = may_follow(state) & ((F.col("copies") == 1) | may_follow(state_of(F.col("role"))))
    judged = seen.select("conv", "turn", "pos", state_of(F.col("role")).alias("state"), good.alias("good"))
    verdict = judged.groupBy("conv").agg(
        F.min("good").alias("good"), F.min(F.when(~F.col("good"), F.col("turn"))).alias("broken_at"), F.max_by("state", "pos").alias("state")
    )
    valid = F.col("good") & F.col("state").isin(*sorted(template.final))
    return verdict.select(F.col("conv").alias(conv_col), valid.alias("valid"), "broken_at")


def format_chat(
    chats: DataFrame, template: Template = TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conversation, segments, valid, broken_at): one row per conversation; segments are (kind, text, loss) in order."""
    rows = _segments(_rows(chats, conv_col, turn_col, role_col, text_col), template)
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "t", "segments"))).alias("turns"))
    whole = whole.select("conv", F.flatten(F.col("turns.segments")).alias("segments"))
    verdict = turn_order(chats, template, conv_col, turn_col, role_col).withColumnRenamed(conv_col, "_conv")
    joined = whole.join(verdict, F.col("conv").eqNullSafe(F.col("_conv")))
    return joined.select(F.col("conv").alias(conv_col), "segments", "valid", "broken_at")


def formatted(segments: Column) -> Column:
    """The text of a conversation: all its segments, one after the other."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column, template: Template = TURNS) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    mark = template.closing_before + template.closing + template.closing_after
    pieces = F.split(text, rf"\Q{mark}\E", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)  # nothing follows the last mark

    def read(piece: Column) -> Column:
        close = F.instr(piece, template.other_after)
        name = F.substring(piece, F.lit(len(template.other) + 1), close - F.lit(len(template.other) + 1))
        role, text = F.decode(F.unhex(name), "UTF-8"), F.substring(piece, close + F.lit(len(template.other_after)), F.length(piece))
        for known, turn in template.turns.items():
            opens = F.startswith(piece, F.lit(turn.opening))
            role = F.when(opens, F.lit(known)).otherwise(role)
            text = F.when(opens, F.substring(piece, F.lit(len(turn.opening) + 1), F.length(piece))).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text, template).alias("text"))

    return F.transform(pieces, read)


def learnt_text(segments: Column, template: Template = TURNS) -> Column:
    """All text under the loss mask, as it was before formatting."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
