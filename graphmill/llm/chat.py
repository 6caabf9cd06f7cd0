"""Chat formatting with DataFrame expressions only.

A declarative ``Template`` lists the marks around turns, the control strings that
must not occur inside texts, and a finite-state machine over roles. Every turn
becomes text segments with a loss flag each, numbered by windows, so no
conversation has to fit in one row until it is put together; then the machine is
run over its roles. Control strings inside texts are escaped reversibly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written.

    ``marks`` maps a role to (before, after); ``other`` holds the pair for roles
    without one, with ``{role}`` for the role's name. ``moves`` is the machine: it
    maps (state, role) to the next state; what it does not list is not allowed.
    """

    name: str
    begin: str
    end: str
    marks: dict[str, tuple[str, str]]
    other: tuple[str, str]
    trained: tuple[str, ...]
    control: tuple[str, ...]
    start: str
    moves: dict[tuple[str, str], str]
    final: tuple[str, ...]
    escape: str = "\\"

    def after(self) -> dict[str, str] | None:
        """The state after each role, if it follows from the role alone."""
        out: dict[str, str] = {}
        return out if all(out.setdefault(role, to) == to for (_, role), to in self.moves.items()) else None

    def check(self) -> None:
        codes = "0" + "".join(chr(97 + k) for k in range(len(self.control)))
        if len(self.escape) != 1 or self.escape.isalnum():
            raise ValueError("the escape is one character, no letter or digit")
        if any(c and c[0] in codes for c in self.control):
            raise ValueError(f"control strings must not begin with one of {codes!r}, which follow the escape character")
        if len(self.control) > 26 or any(self.escape in c or not c for c in self.control):
            raise ValueError("control strings: at most 26, not empty, without the escape character")
        written = [self.begin, self.end, *self.other, *(m for pair in self.marks.values() for m in pair)]
        for m in filter(None, written):
            if not any(c in m for c in self.control):
                raise ValueError(f"mark {m!r} holds no control string")


INSTRUCT = Template(
    name="instruct",
    begin="<s>",
    end="</s>",
    marks={"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "[/ANS]")},
    other=("[TURN]{role}[AS]", "[/TURN]"),
    trained=("assistant",),
    control=("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANS]", "[/ANS]", "[TURN]", "[AS]", "[/TURN]"),
    start="start",
    moves={
        ("start", "system"): "briefed",
        ("start", "user"): "asked",
        ("briefed", "user"): "asked",
        ("answered", "user"): "asked",
        ("asked", "assistant"): "answered",
    },
    final=("answered",),
)


def escape_text(text: Column, template: Template) -> Column:
    """Each escape character becomes itself and ``0``, each control string the escape character and a letter."""
    e = template.escape
    steps = [(e, e + "0"), *((c, e + chr(97 + k)) for k, c in enumerate(template.control))]
    return reduce(lambda t, step: F.replace(t, F.lit(step[0]), F.lit(step[1])), steps, text)


def unescape_text(text: Column, template: Template) -> Column:
    e = template.escape
    steps = [*((e + chr(97 + k), c) for k, c in enumerate(template.control)), (e + "0", e)]
    return reduce(lambda t, step: F.replace(t, F.lit(step[0]), F.lit(step[1])), steps, text)


def format_chat(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Segments of all conversations: ``conv_id, turn_no, part, role, text, loss, in_order``.

    ``turns`` has ``conv_id, turn, role, text``. Per turn there are three parts
    (0 mark before, 1 text, 2 mark after); the first turn's mark carries the
    conversation's begin, the last one's its end. ``turn_no`` counts from 0 in
    (turn, role, text) order, nulls first, so ties and repeated rows have a fixed
    place. ``in_order`` is whether the machine allows the turn's role after the
    role before it and, for the last turn, ends in a final state; null where the
    state does not follow from the role before (``conversations`` runs the machine
    then, too); a turn that is not allowed is written all the same. Null role and text count as empty, a
    null ``conv_id`` is a conversation of its own, further columns are not read.
    """
    template.check()
    base = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    after = template.after()
    before = F.lag("role").over(order)
    placed = base.select(
        "*",
        (F.row_number().over(order) - 1).alias("turn_no"),
        before.alias("before"),
        F.lead(F.lit(1)).over(order).isNull().alias("last"),
    )
    in_order = F.lit(None).cast("boolean")
    if after:
        was = F.when(F.col("turn_no") == 0, F.lit(template.start)).otherwise(F.try_element_at(F.create_map(*(F.lit(x) for kv in after.items() for x in kv)), F.col("before")))
        allowed = F.concat_ws("\x00", was, F.col("role")).isin([f"{s}\x00{r}" for s, r in template.moves]) & was.isNotNull()
        ends = F.col("role").isin([r for r, to in after.items() if to in template.final])
        in_order = F.coalesce(allowed & (~F.col("last") | ends), F.lit(False))

    def mark(k: int) -> Column:
        name = escape_text(F.col("role"), template)
        out = F.replace(F.lit(template.other[k]), F.lit("{role}"), name)
        for role, pair in template.marks.items():
            out = F.when(F.col("role") == role, F.lit(pair[k])).otherwise(out)
        return out

    opened = F.concat(F.when(F.col("turn_no") == 0, F.lit(template.begin)).otherwise(F.lit("")), mark(0))
    closed = F.concat(mark(1), F.when(F.col("last"), F.lit(template.end)).otherwise(F.lit("")))
    no = F.lit(False)
    parts = F.array(
        F.struct(F.lit(0).alias("part"), opened.alias("text"), no.alias("loss")),
        F.struct(F.lit(1).alias("part"), escape_text(F.col("text"), template).alias("text"), F.col("role").isin(*template.trained).alias("loss")),
        F.struct(F.lit(2).alias("part"), closed.alias("text"), no.alias("loss")),
    )
    flat = placed.select("conv_id", "turn_no", "role", in_order.alias("in_order"), F.explode(parts).alias("s"))
    return flat.select("conv_id", "turn_no", "s.part", "role", "s.text", "s.loss", "in_order")


def conversations(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """``conv_id, segments, formatted, valid``: one row per conversation, its segments in order.

    ``valid`` is the machine's verdict: a fold of the moves over the ordered roles,
    from the start to a final state. A conversation is one training example and so
    one row; splitting it earlier is the caller's choice. Nulls, ties, repeated
    rows and empty tables as in ``format_chat``.
    """
    row = F.struct("turn_no", "part", "role", "text", "loss")
    grouped = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("segments"))
    table = F.create_map(*(F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\x00{role}", to)))
    dead = F.lit("\x00")  # no state's name: nothing leads out of it
    roles = F.transform(F.filter("segments", lambda s: s.part == 1), lambda s: s.role)
    last = F.aggregate(roles, F.lit(template.start), lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit("\x00"), role)), dead))
    return grouped.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), last.isin(*template.final).alias("valid"))


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Digests of what ``conversations`` wrote: turns from the formatted string, loss text from the mask."""
    inner = F.substring(F.col("formatted"), F.lit(len(template.begin) + 1), F.length("formatted") - len(template.begin) - len(template.end))
    quote = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
    named = {role: pair for role, pair in template.marks.items()}
    closers = [pair[1] for pair in named.values()] + [template.other[1]]
    turns = F.filter(F.split(inner, "|".join(map(quote, closers))), lambda t: F.length(t) > 0)
    between = template.other[0].split("{role}")

    def turn(t: Column) -> Column:
        other = F.substring(t, F.lit(len(between[0]) + 1), F.length(t))
        out = F.concat(unescape_text(F.substring_index(other, between[1], 1), template), F.lit("\n"), unescape_text(F.substring(other, F.instr(other, between[1]) + len(between[1]), F.length(other)), template))
        for role, (opened, _) in named.items():
            out = F.when(F.startswith(t, F.lit(opened)), F.concat(F.lit(role + "\n"), unescape_text(F.substring(t, F.lit(len(opened) + 1), F.length(t)), template))).otherwise(out)
        return F.concat(out, F.lit("\n"))

    learned = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape_text(s.text, template)), "")
    read = formatted.select("conv_id", "valid", "formatted", turns.alias("turns"), learned.alias("learned"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", turn), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -7, whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
