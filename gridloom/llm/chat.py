"""Chat formatting with schema fingerprints, in DataFrame functions only.

A table's nested field paths are hashed, and the hash selects a declarative mapping that
turns its layout (rows by turn, lists of messages, prompt and completion, instruction,
input and output) into canonical turns: conv_id, turn, role, text. Of the paths that a
table has, those that a layout names are hashed for each layout in turn, lists of messages
first, and the first one that finds its fingerprint is it: so extra columns don't hide a
layout, even if another layout knows their names.

Turns are written as ``### role: text</turn>`` and a line feed each. Backslashes, three
number signs in a row, the end mark and, in roles, colons are escaped, so that the marks
occur nowhere else and reading back gives the very roles and texts. The loss mask lists the
spans of the assistant's (escaped) texts.

Null roles and texts count as empty. Turns are in the order of turn (null first), role and
text; rows that repeat are turns of their own. A conversation is assembled from blocks of
BLOCK turns, so that one with a third of all rows is spread over many tasks until its one
row is made. A conversation whose list of messages is null or empty has no turns and no row in
the result, and an empty table gives an empty result. Texts are taken whole at any length.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 256
END = "</turn>"

#: Layouts: the paths that tell them, and the turns as an SQL expression (an array of structs), or None for rows by turn.
LAYOUTS: dict[str, tuple[tuple[str, ...], str | None]] = {
    "messages": (("conv_id", "messages[].content", "messages[].role"), "transform(messages, (m, i) -> struct(cast(i as bigint) as turn, m.role as role, m.content as text))"),
    "from and value": (("conv_id", "conversations[].from", "conversations[].value"), "transform(conversations, (m, i) -> struct(cast(i as bigint) as turn, case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end as role, m.value as text))"),
    "turn rows": (("conv_id", "role", "text", "turn"), None),
    "instruction, input and output": (("conv_id", "input", "instruction", "output"), "array(struct(0L as turn, 'user' as role, if(coalesce(input, '') = '', instruction, concat(coalesce(instruction, ''), '\\n\\n', input)) as text), struct(1L as turn, 'assistant' as role, output as text))"),
    "instruction and output": (("conv_id", "instruction", "output"), "array(struct(0L as turn, 'user' as role, instruction as text), struct(1L as turn, 'assistant' as role, output as text))"),
    "prompt and completion": (("completion", "conv_id", "prompt"), "array(struct(0L as turn, 'user' as role, prompt as text), struct(1L as turn, 'assistant' as role, completion as text))"),
    "prompt and response": (("conv_id", "prompt", "response"), "array(struct(0L as turn, 'user' as role, prompt as text), struct(1L as turn, 'assistant' as role, response as text))"),
}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """All paths to leaves; ``[]`` stands for an array's elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


_FINGERPRINTS = {name: fingerprint(paths) for name, (paths, _) in LAYOUTS.items()}


def layout_of(schema: T.StructType) -> str:
    """The first layout whose fingerprint its paths in a schema have."""
    present = set(field_paths(schema))
    for name, (paths, _) in LAYOUTS.items():
        if fingerprint(present.intersection(paths)) == _FINGERPRINTS[name]:
            return name
    raise ValueError(f"no layout has its fields among {sorted(present)}")


def canonical_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, whatever the layout."""
    turns = LAYOUTS[layout_of(df.schema)][1]
    if turns is None:
        return df.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return df.select("conv_id", F.explode(F.expr(turns)).alias("t")).select("conv_id", F.col("t.turn").alias("turn"), F.col("t.role").cast("string").alias("role"), F.col("t.text").cast("string").alias("text"))


def escape(text: Column) -> Column:
    for find, put in (("\\", "\\\\"), ("###", "\\#\\#\\#"), (END, "<\\/turn>")):
        text = F.replace(text, F.lit(find), F.lit(put))
    return text


def unescape(text: Column) -> Column:
    """Undoes escape(): doubled backslashes separate the stretches in which the other escapes are replaced."""
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\#"), F.lit("#")), F.lit("<\\/turn>"), F.lit(END)), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def format_turns(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id and blocks, an array of formatted text and the spans of loss in it, in characters."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("### "), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(": "))
    body = escape(text)
    rows = turns.select("conv_id", "turn", F.floor(F.col("turn") / BLOCK).alias("block"), role.alias("role"), text.alias("text"), head.alias("head"), body.alias("body"))
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("turns"))
    written = blocks.select(
        "conv_id",
        "block",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "").alias("text"),
        F.expr(f"""aggregate(turns, struct(0L as at, cast(array() as array<struct<begin:bigint,end:bigint>>) as spans),
            (s, t) -> struct(s.at + char_length(t.head) + char_length(t.body) + {len(END) + 1} as at,
                if(t.role = 'assistant', array_append(s.spans, struct(s.at + char_length(t.head) as begin, s.at + char_length(t.head) + char_length(t.body) as end)), s.spans) as spans),
            s -> s.spans)""").alias("spans"),
    )
    return written.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "text", "spans"))).alias("blocks")).select("conv_id", F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), b["spans"].alias("spans"))).alias("blocks"))


def assembled(formatted: DataFrame) -> DataFrame:
    """Per conversation: conv_id, the whole text and the spans of loss in it."""
    moved = """aggregate(blocks, struct(0L as at, cast(array() as array<struct<begin:bigint,end:bigint>>) as spans),
        (s, b) -> struct(s.at + char_length(b.text) as at, concat(s.spans, transform(b.spans, x -> struct(x.begin + s.at as begin, x.end + s.at as end))) as spans), s -> s.spans)"""
    return formatted.select("conv_id", F.array_join(F.transform("blocks", lambda b: b["text"]), "").alias("formatted"), F.expr(moved).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its formatted text: turns (role and text), loss (the texts under the mask, one entry a span) and formatted_chars."""

    def turns(block: Column) -> Column:
        pieces = F.split(block["text"], END + "\n", -1)
        pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

        def turn(piece: Column) -> Column:
            role = F.substring_index(piece, ": ", 1)
            return F.struct(unescape(F.substring(role, F.lit(5), F.char_length(role))).alias("role"), unescape(F.substring(piece, F.char_length(role) + 3, F.char_length(piece))).alias("text"))

        return F.transform(pieces, turn)

    loss = lambda block: F.transform(block["spans"], lambda s: unescape(F.substring(block["text"], (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))))
    return formatted.select(
        "conv_id",
        F.flatten(F.transform("blocks", turns)).alias("turns"),
        F.flatten(F.transform("blocks", loss)).alias("loss"),
        F.aggregate("blocks", F.lit(0).cast("bigint"), lambda s, b: s + F.char_length(b["text"])).alias("formatted_chars"),
    )
