"""Chat formatting by schema fingerprints, in built-in functions only.

Rows may hold their conversation in any of several layouts (a list of messages, a prompt and its
completion, an instruction with an input ...).  The paths of the nested fields that a row fills are
sorted and hashed; the hash picks a declarative mapping to canonical turns, array<struct<role,text>>.

The template marks a turn as ``<|role|>R<|text|>T<|end|>``.  Inside R and T a backslash goes into every
control string, after its first character and any backslashes that are there already; one backslash
comes out again on reading.  So no mark of this template, nor ``<s>``, ``</s>``, ``[INST]`` or ``[/INST]``, is
left inside a text, and what is read back equals what went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import set_aside

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: What may follow ``<`` or ``[`` in a control string.
CONTROL_TAILS = (r"\|", "/?s>", r"/?INST\]")

TURNS = "array<struct<role:string,text:string>>"
#: Roles as the ``conversations`` layout names them.
_FROM = "CASE lower(m.from) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE m.from END"

#: Layout -> (paths of its fields, SQL expression of its turns).
LAYOUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": (("messages[].content", "messages[].role"), "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    "conversations": (("conversations[].from", "conversations[].value"), f"transform(conversations, m -> named_struct('role', {_FROM}, 'text', m.value))"),
    "prompt_completion": (("completion", "prompt"), "array(named_struct('role', 'user', 'text', prompt), named_struct('role', 'assistant', 'text', completion))"),
    "prompt_response": (("prompt", "response"), "array(named_struct('role', 'user', 'text', prompt), named_struct('role', 'assistant', 'text', response))"),
    "system_prompt_response": (("prompt", "response", "system"), "array(named_struct('role', 'system', 'text', system), named_struct('role', 'user', 'text', prompt), named_struct('role', 'assistant', 'text', response))"),
    "instruction": (("instruction", "output"), "array(named_struct('role', 'user', 'text', instruction), named_struct('role', 'assistant', 'text', output))"),
    "instruction_input": (("input", "instruction", "output"), "array(named_struct('role', 'user', 'text', concat(instruction, '\\n\\n', input)), named_struct('role', 'assistant', 'text', output))"),
}


def _paths(kind: T.DataType, at: str, value: Column) -> list[tuple[str, Column]]:
    """(path, present) of the leaves below a column; a list's fields are there if the list is."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _paths(f.dataType, f"{at}.{f.name}", value[f.name])]
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType):
            return [(f"{at}[].{f.name}", value.isNotNull()) for f in kind.elementType.fields]
        return [(f"{at}[]", value.isNotNull())]
    return [(at, value.isNotNull())]


def fingerprint(records: DataFrame, layouts: dict = LAYOUTS) -> Column:
    """Hash of the sorted paths that a row fills, of those that any layout uses; others are extra columns."""
    used = {p for paths, _ in layouts.values() for p in paths}
    there = sorted((p for f in records.schema.fields for p in _paths(f.dataType, f.name, F.col(f"`{f.name}`")) if p[0] in used), key=lambda p: p[0])
    named = [F.when(present, F.lit(path)) for path, present in there]
    return F.md5(F.array_join(F.array_compact(F.array(*named, F.lit(None).cast("string"))), "\n"))


def canonical_turns(records: DataFrame, layouts: dict = LAYOUTS) -> DataFrame:
    """records with ``layout`` and ``turns``, both null where no mapping has the row's fingerprint.

    Null roles and texts become empty.
    """
    have = {p for f in records.schema.fields for p, _ in _paths(f.dataType, f.name, F.col(f"`{f.name}`"))}
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, (paths, made) in layouts.items():
        if have.issuperset(paths):
            own = F.col("_print") == F.md5(F.lit("\n".join(sorted(paths))))
            layout, turns = F.when(own, name).otherwise(layout), F.when(own, F.expr(made)).otherwise(turns)
    own, back = set_aside(records, ["_print"])
    out = back(own.withColumn("_print", fingerprint(own, layouts)).withColumns({"layout": layout, "turns": turns}).drop("_print"))
    return out.withColumn("turns", F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({'|'.join(CONTROL_TAILS)})", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\({'|'.join(CONTROL_TAILS)})", "$1$2$3")


def format_turns(turns: Column) -> tuple[Column, Column]:
    """(formatted text, loss mask).  The mask has for each turn how many characters come before the
    masked run and how long that is; it is 0 but for assistant turns.  Null turns give null."""
    one = lambda t: F.concat(F.lit(ROLE), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))
    skip = lambda t: F.lit(len(ROLE + TEXT)) + F.length(escape(t["role"]))
    take = lambda t: F.when(t["role"] == "assistant", F.length(escape(t["text"]))).otherwise(0)
    return F.array_join(F.transform(turns, one), ""), F.transform(turns, lambda t: F.struct(skip(t).alias("skip"), take(t).alias("take")))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text; the inverse of ``format_turns``."""
    parts = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    halves = F.transform(parts, lambda p: F.split(p, r"<\|text\|>"))
    return F.transform(halves, lambda h: F.struct(unescape(F.substring(h[0], len(ROLE) + 1, 2147483647)).alias("role"), unescape(h[1]).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order, with nothing between."""
    parts = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    return F.array_join(F.zip_with(parts, mask, lambda p, m: unescape(F.substr(p, m["skip"] + 1, m["take"]))), "")


def gather_turns(rows: DataFrame) -> DataFrame:
    """conv_id and ``messages``, from rows of conv_id, turn, role and text; one row per conv_id, null too.

    Turns go by (turn, role, text), null first, so ties and repeated rows have a fixed order and each
    counts as a turn.  A formatted conversation is one value, so one task holds one conversation.
    """
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))


def format_conversations(records: DataFrame) -> DataFrame:
    """records in any known layout, with layout, turns, formatted and loss_mask; the last three are null
    for rows of unknown layouts, which stay.  Columns of these names are replaced, other ones stay; repeated
    rows are formatted each, and an empty table stays empty."""
    made = canonical_turns(records)
    formatted, mask = format_turns(F.col("turns"))
    return made.withColumns({"formatted": formatted, "loss_mask": mask})
