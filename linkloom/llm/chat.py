"""Chat formatting: schema fingerprints choose how records become turns, a template renders these.

The nested field paths of a record, without types and in order of names, are
hashed; the hash selects one of the declared ``LAYOUTS``, which says where turns,
roles and texts are. Records are either typed columns, whose paths are known from
the schema, or JSON strings of any mixture of layouts, whose paths are read from
each record.

Template of a turn: ``### role: text</turn>`` and a line break. Inside roles and
texts the backslash becomes ``\\b``, ``<`` ``\\l`` and ``#`` ``\\h``, in roles also
``:`` ``\\c`` and a line break ``\\n``: control strings cannot occur there, every
backslash starts one of these pairs, and replacing the pairs back, the backslash
last, restores the text. The loss mask covers the escaped texts of assistants.

All on DataFrame functions. A conversation is one string and its digests need
all of it, so a conversation's turns meet in one task; they are sorted there with
spill. Defined cases: null texts and roles are empty; turns of equal number are
ordered by role, then text; repeated rows are turns each; turns without a
conversation id form one conversation; records of an undeclared layout have the
layout null and no turns; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

ASSISTANT = "assistant"
_OPEN, _MIDDLE, _CLOSE = "### ", ": ", "</turn>\n"
_TEXT_PAIRS = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_ROLE_PAIRS = (*_TEXT_PAIRS, (":", "\\c"), ("\n", "\\n"))


def fingerprint_of(paths: str) -> int:
    """60 bits of the SHA-256 of field paths; ``fingerprint`` is the same as a column."""
    return int(hashlib.sha256(paths.encode()).hexdigest()[:15], 16)


@dataclass(frozen=True)
class Layout:
    """Field paths, and where the turns are.

    Either ``turns``: pairs of a role and the fields whose non-empty texts, joined
    by a blank line, are its text; turns whose fields are all empty are left out
    unless the role is last. Or ``each`` (a list of records, or "" for the record
    itself) with the fields ``role`` and ``text``.
    """

    paths: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""


LAYOUTS = {
    "turn row": Layout("OBJECT<role, text, turn>", role="role", text="text"),
    "messages": Layout("OBJECT<messages: ARRAY<OBJECT<content, role>>>", each="messages", role="role", text="content"),
    "conversations": Layout("OBJECT<conversations: ARRAY<OBJECT<from, value>>>", each="conversations", role="from", text="value"),
    "instruction": Layout("OBJECT<instruction, output>", (("user", ("instruction",)), (ASSISTANT, ("output",)))),
    "instruction with input": Layout("OBJECT<input, instruction, output>", (("user", ("instruction", "input")), (ASSISTANT, ("output",)))),
    "prompt and response": Layout("OBJECT<prompt, response>", (("user", ("prompt",)), (ASSISTANT, ("response",)))),
    "prompt and completion": Layout("OBJECT<completion, prompt>", (("user", ("prompt",)), (ASSISTANT, ("completion",)))),
    "system, prompt and response": Layout("OBJECT<prompt, response, system>", (("system", ("system",)), ("user", ("prompt",)), (ASSISTANT, ("response",)))),
    "question and answer": Layout("OBJECT<answer, question>", (("user", ("question",)), (ASSISTANT, ("answer",)))),
}
#: Fingerprint to layout, the one table by which typed columns and JSON records select.
FINGERPRINTS = {fingerprint_of(layout.paths): name for name, layout in LAYOUTS.items()}
#: Names that other layouts have for the canonical roles.
ROLES = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
_TURN = "struct<role:string,text:string>"


def schema_paths(kind: T.DataType) -> str:
    """Field paths of a type, without leaf types."""
    if isinstance(kind, T.StructType):
        fields = [(f.name, schema_paths(f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return "OBJECT<" + ", ".join(n + (f": {p}" if p else "") for n, p in fields) + ">"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{schema_paths(kind.elementType)}>"
    return ""


def record_paths(record: Column) -> Column:
    """Field paths of a parsed JSON record, without leaf types."""
    return F.regexp_replace(F.schema_of_variant(record), r"(: )?\b(?:VOID|BOOLEAN|BIGINT|DOUBLE|STRING|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "")


def fingerprint(paths: Column) -> Column:
    return F.conv(F.substring(F.sha2(paths.cast("string"), 256), 1, 15), 16, 10).cast("long")


def _canonical(role: Column) -> Column:
    lower = F.lower(F.trim(role))
    named = F.lit(None).cast("string")
    for other, own in ROLES.items():
        named = F.when(lower == other, F.lit(own)).otherwise(named)
    return F.coalesce(named, role, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(_canonical(role.cast("string")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turns(layout: Layout, field: Callable[[str], Column], items: Callable[[Layout], Column]) -> Column:
    if layout.each:
        return F.transform(items(layout), lambda m: _turn(m[layout.role], m[layout.text]))
    if layout.role:  # a row of a table of turns, whose roles are names of its own
        turn = _turn(field(layout.role), field(layout.text))
        return F.array(turn.withField("role", F.coalesce(field(layout.role).cast("string"), F.lit(""))))
    made = []
    for k, (role, fields) in enumerate(layout.turns):
        text = F.array_join(F.filter(F.array(*[field(f).cast("string") for f in fields]), lambda x: x != ""), "\n\n")
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        made.append(turn if k == len(layout.turns) - 1 else F.when(text != "", turn))
    return F.filter(F.array(*made), lambda t: t.isNotNull())


def turns_of_columns(frame: DataFrame, record: str) -> tuple[str | None, Column]:
    """The layout of a typed struct column, by its fingerprint, and its turns."""
    name = FINGERPRINTS.get(fingerprint_of(schema_paths(frame.schema[record].dataType)))
    if name is None:
        return None, F.expr(f"cast(array() as array<{_TURN}>)")
    return name, _turns(LAYOUTS[name], lambda f: F.col(f"{record}.{f}"), lambda own: F.col(f"{record}.{own.each}"))


def turns_of_json(frame: DataFrame, record: str) -> DataFrame:
    """``frame`` with the columns layout and turns for the JSON string column ``record``."""
    parsed = frame.withColumn("__v", F.try_parse_json(F.col(record)))
    parsed = parsed.withColumn("__print", fingerprint(record_paths(F.col("__v"))))
    name, turns = F.lit(None).cast("string"), F.expr(f"cast(array() as array<{_TURN}>)")
    for print_, own in FINGERPRINTS.items():
        layout, here = LAYOUTS[own], F.col("__print") == F.lit(print_)
        items = lambda x: F.try_variant_get("__v", f"$.{x.each}", f"array<struct<{x.role}:string,{x.text}:string>>")
        found = _turns(layout, lambda f: F.try_variant_get("__v", f"$.{f}", "string"), items)
        name, turns = F.when(here, F.lit(own)).otherwise(name), F.when(here, found).otherwise(turns)
    return parsed.withColumns({"layout": name, "turns": turns}).drop("__v", "__print")


def escape(text: Column, pairs: tuple = _TEXT_PAIRS) -> Column:
    for raw, pair in pairs:
        text = F.replace(text, F.lit(raw), F.lit(pair))
    return text


def unescape(text: Column, pairs: tuple = _TEXT_PAIRS) -> Column:
    for raw, pair in reversed(pairs):
        text = F.replace(text, F.lit(pair), F.lit(raw))
    return text


def render(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from turns (conv_id, turn, role, text).

    loss_spans has a struct for each turn in order: start and length of its text
    in ``formatted`` (code points), within: start in the turn's own part; length
    is 0 for turns without loss.
    """
    parts = rows.select("conv_id", "turn", "role", "text", F.concat(F.lit(_OPEN), escape(F.col("role"), _ROLE_PAIRS), F.lit(_MIDDLE)).alias("head"), escape(F.col("text")).alias("body"))
    parts = parts.withColumn("part", F.concat("head", "body", F.lit(_CLOSE)))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("at", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)))
    within = F.length("head").cast("long")
    length = F.when(F.col("role") == ASSISTANT, F.length("body")).otherwise(0).cast("long")
    own = F.struct("at", "part", F.struct((F.col("at") + within).alias("start"), length.alias("length"), within.alias("within")).alias("loss"))
    ordered = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("parts"))
    return ordered.select("conv_id", F.array_join("parts.part", "").alias("formatted"), F.col("parts.loss").alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.filter(F.split(formatted, _CLOSE), lambda p: p != "")
    role_ends = lambda p: F.instr(p, F.lit(_MIDDLE))
    role = lambda p: unescape(F.substring(p, F.lit(len(_OPEN) + 1), role_ends(p) - (len(_OPEN) + 1)), _ROLE_PAIRS)
    text = lambda p: unescape(F.substring(p, role_ends(p) + len(_MIDDLE), F.length(p)))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    pieces = F.filter(F.split(formatted, _CLOSE), lambda p: p != "")
    return F.array_join(F.zip_with(pieces, loss_spans, lambda p, s: unescape(F.substring(p, (s["within"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_turn_rows(conversations: DataFrame) -> DataFrame:
    """``render`` of a table that has a row a turn (conv_id, turn, role, text), through its layout."""
    prepare(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("record"))
    _, turns = turns_of_columns(rows, "record")
    return render(rows.select("conv_id", "record.turn", F.explode(turns).alias("t")).select("conv_id", "turn", "t.role", "t.text"))
