"""JSON in cells: paths, and documents as tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coerce import col

_STEP = re.compile(r"\.?([^.\[\]]+)|\[(\d+)\]|\[(?:'([^']*)'|\"([^\"]*)\")\]")


def path_steps(path: str) -> list[str | int]:
    """Steps of a dotted path with ``[i]``, with or without ``$``; ValueError for another form."""
    rest = path[1:] if path.startswith("$") else path
    steps, at = [], 0
    while at < len(rest):
        m = _STEP.match(rest, at)
        if not m:
            raise ValueError(f"not a path: {path!r}")
        steps.append(int(m[2]) if m[2] is not None else next(x for x in (m[1], m[3], m[4]) if x is not None))
        at = m.end()
    return steps


def spark_path(path: str) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in path_steps(path))


def json_path(text: Column, path: str) -> Column:
    """The value at a path as text: nested values as JSON; null where there is nothing, a JSON null, or no JSON."""
    where = spark_path(path)
    return text if where == "$" else F.get_json_object(text, where)


def json_path_status(text: Column, path: str) -> Column:
    """Why ``json_path`` is null: ``blank``, ``malformed``, ``missing`` or ``null``; ``ok`` otherwise."""
    where = spark_path(path)
    parsed = F.try_parse_json(text)
    value = F.try_variant_get(parsed, where, "variant")
    return F.when(text.isNull() | (F.trim(text) == ""), "blank").when(parsed.isNull(), "malformed").when(value.isNull(), "missing").when(F.is_variant_null(value), "null").otherwise("ok")


def _first_seen(rows: DataFrame, order_by: str, doc: str) -> list[str]:
    """Keys of all objects in the order first seen."""
    keys = rows.select(order_by, "_pos", F.posexplode(F.json_object_keys(doc)).alias("_k", "key")).groupBy("key").agg(F.min(F.struct(order_by, "_pos", "_k")).alias("_first"))
    return [r[0] for r in keys.orderBy("_first").select("key").collect()]


def parse_json(df: DataFrame, text: str, path: str = "$", *, order_by: str, fields: Sequence[str] | None = None) -> DataFrame:
    """Rows of the documents in a text column, in the order (order_by, ``position``).

    Each document has its own form. An array of objects alone gives a row each, with a text column for each key in the order first
    seen (``fields`` saves the pass that finds them; the number of keys is the width of the result; a key with the name of another
    column of the result gets an underscore); another array a row each with ``value``; an object rows of ``key`` and ``value``; a
    scalar one row with ``value``. An empty array or object, and text that is no JSON, give one blank row. The result has the columns
    that the forms found ask for, null in the rows of other forms.
    """
    where = spark_path(path)
    source = df.select(col(order_by).alias(order_by), (col(text) if where == "$" else F.get_json_object(col(text), where)).alias("_j")).where("_j is not null")
    source = source.withColumn("_items", F.when(F.ltrim("_j").startswith("["), F.from_json("_j", "array<string>")))
    # Text items may look like objects: what an item is, the parsed document knows.
    typed = F.forall(F.try_variant_get(F.try_parse_json("_j"), "$", "array<variant>"), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    is_table = F.coalesce(typed, F.forall("_items", lambda x: F.ltrim(x).startswith("{")), F.lit(False)) & (F.size("_items") > 0)
    form = F.when(F.col("_items").isNotNull(), F.when(is_table, "table").otherwise("list")).when(F.ltrim("_j").startswith("{"), "object").otherwise("scalar")
    source = source.withColumn("_form", form)
    forms = {r[0] for r in source.select("_form").distinct().collect()}  # four at most
    items = source.where("_form = 'table'").select(order_by, F.posexplode("_items").alias("_pos", "_item"))
    names = (list(fields) if fields is not None else _first_seen(items, order_by, "_item")) if "table" in forms else []
    plain = bool(forms - {"table"}) or not names
    own = [order_by, "position", *(["key"] if "object" in forms else []), *(["value"] if plain else [])]
    label = {}
    for n in names:
        label[n] = n
        while label[n] in own or list(label.values()).count(label[n]) > 1:
            label[n] += "_"
    text_ = T.StringType()

    def shaped(rows: DataFrame, **given: Column) -> DataFrame:
        blank = F.lit(None).cast(text_)
        return rows.select(order_by, F.coalesce("_pos", F.lit(0)).alias("position"), *[given.get(c, blank).alias(c) for c in own[2:]], *[given.get("_cells", {}).get(n, blank).alias(label[n]) for n in names])

    parts = []
    if "table" in forms:
        record = items.withColumn("_r", F.from_json("_item", T.MapType(text_, text_)))
        parts.append(shaped(record, _cells={n: F.try_element_at("_r", F.lit(n)) for n in names}))
    if "list" in forms:
        parts.append(shaped(source.where("_form = 'list'").select(order_by, F.posexplode_outer("_items").alias("_pos", "_item")), value=F.col("_item")))
    if "object" in forms:
        pairs = source.where("_form = 'object'").select(order_by, F.from_json("_j", T.MapType(text_, text_)).alias("_r"), F.posexplode_outer(F.json_object_keys("_j")).alias("_pos", "_key"))
        parts.append(shaped(pairs, key=F.col("_key"), value=F.try_element_at("_r", F.col("_key"))))
    if "scalar" in forms or not parts:
        parts.append(shaped(source.where("_form = 'scalar'").select(order_by, F.lit(0).alias("_pos"), "_j"), value=F.expr("try_variant_get(try_parse_json(_j), '$', 'string')")))
    return reduce(DataFrame.unionByName, parts)
