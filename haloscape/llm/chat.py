"""Chat formatting: canonical turns by schema fingerprint, and a reversible template with a loss mask.

Records of any layout come as a VARIANT column.  A layout declares the nested field paths that it is told by; their hash is its fingerprint.  Of
these paths those that a record has are hashed, and the layout whose fingerprint comes out maps the record to canonical turns (order,
role, text).  Of several layouts that fit, the one with most paths counts, then the first; so fields that a layout doesn't name, and those of less
specific layouts, don't matter.  A record that no layout fits has no turns and a null ``layout``, and its conversation stays.

Template: a turn is ``<|role|>text<|end|>``.  In texts a backslash becomes ``\\b`` and ``<|`` becomes ``<\\p``; in roles a
backslash becomes ``\\b`` and ``|`` becomes ``\\p``.  So ``<|`` only ever opens a mark, ``|>`` closes the first of a turn,
and both replacements can be undone.  The loss mask lists the spans (code points, end exclusive) of assistant texts.

A conversation is one formatted string, so its turns meet in one row; nothing else is gathered.

Defined results: null roles and texts are empty; turns are ordered by turn (null first), then role, then text, and repeated
rows are repeated turns; rows with a null conversation id form one conversation; a null record, like one without a known layout, adds no turn and
counts in ``n_unmapped``; a conversation without turns is an empty string; of the input's other columns none is returned by
``format_conversations``, all by ``canonical_turns`` but those named like its own; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, let, others

TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``paths``: the field paths that a record of this layout has.  Either ``each`` names an array whose elements have a role at
    ``role`` and a text at ``text``; or ``parts`` lists (fixed role, text paths joined by a line break); or, for one
    turn a record, ``role``, ``text`` and ``order`` are paths."""

    name: str
    paths: tuple[str, ...]
    each: str | None = None
    role: str | None = None
    text: str | None = None
    order: str | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


HUMAN = {"human": "user", "gpt": "assistant"}
LAYOUTS = (
    Layout("row", ("$.role", "$.text", "$.turn"), role="$.role", text="$.text", order="$.turn"),
    Layout("messages", ("$.messages", "$.messages[0].content", "$.messages[0].role"), each="$.messages", role="$.role", text="$.content"),
    Layout("messages-text", ("$.messages", "$.messages[0].role", "$.messages[0].text"), each="$.messages", role="$.role", text="$.text"),
    Layout("from-value", ("$.conversations", "$.conversations[0].from", "$.conversations[0].value"), each="$.conversations", role="$.from", text="$.value", roles=HUMAN),
    Layout("conversations", ("$.conversations", "$.conversations[0].content", "$.conversations[0].role"), each="$.conversations", role="$.role", text="$.content"),
    Layout("system-instruction-input", ("$.input", "$.instruction", "$.output", "$.system"), parts=(("system", ("$.system",)), ("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("system-instruction", ("$.instruction", "$.output", "$.system"), parts=(("system", ("$.system",)), ("user", ("$.instruction",)), ("assistant", ("$.output",)))),
    Layout("instruction-input", ("$.input", "$.instruction", "$.output"), parts=(("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("system-prompt-completion", ("$.completion", "$.prompt", "$.system"), parts=(("system", ("$.system",)), ("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Layout("system-prompt-response", ("$.prompt", "$.response", "$.system"), parts=(("system", ("$.system",)), ("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Layout("prompt-completion", ("$.completion", "$.prompt"), parts=(("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Layout("prompt-response", ("$.prompt", "$.response"), parts=(("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Layout("instruction", ("$.instruction", "$.output"), parts=(("user", ("$.instruction",)), ("assistant", ("$.output",)))),
    Layout("instruction-response", ("$.instruction", "$.response"), parts=(("user", ("$.instruction",)), ("assistant", ("$.response",)))),
    Layout("question-answer", ("$.answer", "$.question"), parts=(("user", ("$.question",)), ("assistant", ("$.answer",)))),
    Layout("messages-open", ("$.messages",), each="$.messages", role="$.role", text="$.content"),
    Layout("conversations-open", ("$.conversations",), each="$.conversations", role="$.from", text="$.value", roles=HUMAN),
)


def by_fit(layouts: Sequence[Layout]) -> list[Layout]:
    """The layouts with most paths first."""
    return sorted(layouts, key=lambda layout: -len(layout.paths))


def fingerprint(record: Column, layout: Layout) -> Column:
    """Hash of those of the layout's paths that the record has."""
    has = [F.when(F.try_variant_get(record, p, "variant").isNotNull(), F.lit(p)) for p in sorted(layout.paths)]
    return F.xxhash64(F.concat_ws(",", *has))


def fits(record: Column, layout: Layout) -> Column:
    return record.isNotNull() & (fingerprint(record, layout) == F.xxhash64(F.lit(",".join(sorted(layout.paths)))))


def as_text(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))


def mapped(record: Column, layout: Layout) -> Column:
    """The record's turns under a layout."""

    def turn(order: Column, role: Column, text: Column) -> Column:
        for name, canonical in layout.roles.items():
            role = F.when(role == name, canonical).otherwise(role)
        return F.struct(order.cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))

    if layout.each:
        elements = F.coalesce(F.try_variant_get(record, layout.each, "array<variant>"), F.array().cast("array<variant>"))
        turns = F.transform(elements, lambda e, i: turn(i, as_text(e, layout.role), as_text(e, layout.text)))
    elif layout.parts:
        turns = F.array(*[turn(F.lit(i), F.lit(role), F.array_join(F.filter(F.array(*[as_text(record, p) for p in paths]), lambda x: x != ""), "\n") if len(paths) > 1 else as_text(record, paths[0])) for i, (role, paths) in enumerate(layout.parts)])
    else:
        turns = F.array(turn(F.try_variant_get(record, layout.order, "bigint"), as_text(record, layout.role), as_text(record, layout.text)))
    return turns.cast(TURNS)


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``records`` with ``layout`` (name or null) and ``turns``, its canonical turns (none for an unknown layout)."""
    record, ordered = column(record_col), by_fit(layouts)
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    held = fresh(records.columns, "layout_")[0]
    for layout in reversed(ordered):
        name = F.when(fits(record, layout), layout.name).otherwise(name)
    for layout in ordered:
        turns = F.when(column(held) == layout.name, mapped(record, layout)).otherwise(turns)
    named = records.withColumn(held, name)
    return named.select(*others(records, ("layout", "turns")), column(held).alias("layout"), turns.alias("turns"))


def gather(turned: DataFrame, by: str) -> DataFrame:
    """One row for each value of ``by`` with all its turns in order; columns ``by``, ``turns`` and ``n_unmapped``, the records without a known layout."""
    one = turned.select(column(by).alias("by"), F.col("layout").isNull().alias("unmapped"), F.posexplode_outer("turns").alias("place", "t"))
    unmapped = F.sum(F.col("unmapped").cast("bigint"))
    return one.groupBy("by").agg(F.sort_array(F.collect_list("t")).alias("turns"), unmapped.alias("n_unmapped")).withColumnRenamed("by", by)


def escape_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


END = "<|end|>"


def format_turns(gathered: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``, an array of (start, end) in code points of ``formatted``."""
    marked = F.transform("turns", lambda t: F.struct(F.concat(F.lit("<|"), escape_role(t["role"]), F.lit("|>")).alias("head"), escape_text(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        return F.struct((end + len(END)).alias("at"), F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    held = fresh(gathered.columns, "marked")[0]
    return (
        gathered.withColumn(held, marked)
        .withColumn("formatted", F.array_join(F.transform(held, lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""))
        .withColumn("loss_mask", F.aggregate(held, start, step, lambda acc: acc["spans"]))
        .drop(held)
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, "<\\|end\\|>", -1)

    def turn(piece: Column) -> Column:
        close = F.locate("|>", piece)
        return F.struct(unescape_role(F.substr(piece, F.lit(3), close - 3)).alias("role"), unescape_text(F.substr(piece, close + 2)).alias("text"))

    return let(pieces, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), turn))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape_text(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def format_conversations(records: DataFrame, by: str, record_col: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Columns ``by``, turns, n_unmapped, formatted, loss_mask."""
    return format_turns(gather(canonical_turns(records, record_col, layouts), by))
