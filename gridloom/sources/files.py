"""Readers and writers: delimited text, JSON, newline-delimited JSON, folders, file metadata, tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import col, dtype, to_double, to_text
from ..functions.jsonx import parse_json

#: Extensions that a folder's files are read by; others are comma-separated.
KINDS = {".tsv": "tsv", ".json": "json", ".ndjson": "ndjson", ".jsonl": "ndjson"}


def read_range(spark: SparkSession, name: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """A table, a view or a Parquet path, with only the columns and rows that are wanted read."""
    if any(c in name for c in "[]\r\n"):
        raise ValueError(f"not a name: {name!r}")
    df = spark.read.parquet(name) if "/" in name or name.endswith(".parquet") else spark.table(name)
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def as_doubles(df: DataFrame) -> DataFrame:
    """Every column as numbers, 0 where a cell has none."""
    return df.select(*[F.coalesce(to_double(col(c), dtype(df, c)), F.lit(0.0)).alias(c) for c in df.columns])


def as_strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(to_text(col(c), dtype(df, c)), F.lit("")).alias(c) for c in df.columns])


def _line_facts(spark: SparkSession, path) -> tuple[str | None, bool, int]:
    """A file that ends inside quotes (or None), whether any line does (so that cells go on over lines), and the number of blank lines; one pass over the lines."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    files = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.sum(quotes).alias("quotes"), F.max(quotes % 2).alias("odd"), F.count_if(F.col("value") == "").alias("blank"))
    open_, odd, blank = files.agg(F.min(F.when(F.col("quotes") % 2 == 1, F.col("file"))), F.max("odd"), F.sum("blank")).first()
    return open_, odd == 1, blank or 0


def read_csv(spark: SparkSession, path, *, delimiter: str = ",", encoding: str = "UTF-8", header: bool = False, coerce_numeric: bool = True, schema: T.StructType | str | None = None, strict_quotes: bool = True, multiline: bool | None = None, with_file: bool = False) -> DataFrame:
    """Delimited text with quotes doubled inside quotes and cells over several lines (line ends inside quotes are read as LF); short rows are filled with blanks, a blank line is a row of blanks. Quotes with nothing between are an empty text, a cell without quotes and text is null.

    One pass over the lines finds a file that ends inside quotes (which raises) and whether any cell goes on over lines: only then
    a file can't be split among tasks (and blank lines are skipped). ``strict_quotes=False`` with a given ``multiline`` saves it. With ``coerce_numeric`` columns of
    which every cell is a number or blank are numbers (one more pass; a ``schema`` saves it). ``with_file`` adds each row's file as ``_file``.
    """
    if len(delimiter) != 1:
        raise ValueError("the delimiter is one character")
    blank = 0
    if (strict_quotes or multiline is None) and not encoding.upper().startswith(("UTF-16", "UTF-32")):
        open_, over, blank = _line_facts(spark, path)
        if open_ and strict_quotes:
            raise ValueError(f"{open_} ends inside quotes")
        multiline = over if multiline is None else multiline
    multiline = True if multiline is None else multiline
    # Spark makes cells null that equal nullValue, those of an empty text too if it is empty: it is a value that no file has.
    # Quotes inside quotes are only doubled; by Spark's default NUL would escape there, and be lost.
    reader = spark.read.options(sep=delimiter, encoding=encoding, header=header, multiLine=multiline, quote='"', escape='"', charToEscapeQuoteEscaping='"', nullValue=uuid.uuid4().hex, emptyValue="", mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", False)).csv(path)
    names = df.columns
    if with_file:
        df = df.select("*", F.col("_metadata.file_path").alias("_file"))
    if blank and names and not multiline:
        df = df.unionByName(spark.range(blank).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]))
    if schema is not None or not coerce_numeric or not names:
        return df
    text = T.StringType()
    odd = df.agg(*[F.count_if(to_double(col(c), text).isNull() & col(c).isNotNull() & (col(c) != "")).alias(f"o{i}") for i, c in enumerate(names)], *[F.count(F.nullif(col(c), F.lit(""))).alias(f"n{i}") for i, c in enumerate(names)]).first()
    return df.withColumns({c: to_double(col(c), text) for i, c in enumerate(names) if odd[f"o{i}"] == 0 and odd[f"n{i}"] > 0})


def write_csv(df: DataFrame, path: str, *, delimiter: str = ",", encoding: str = "UTF-8", header: bool = False, single_file: bool = False) -> int:
    """Writes with quotes only where needed (an empty text needs them, to be told from null) and CR LF line ends; gives the number of rows. ``single_file`` puts all rows into one part file."""
    text = df.select(*[to_text(col(c), dtype(df, c)).alias(c) for c in df.columns])
    observed = _Counted()
    rows = text.observe(observed.of, F.count("*").alias("n"))
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").options(sep=delimiter, encoding=encoding, header=header, quote='"', escape='"', lineSep="\r\n", emptyValue='""', nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return observed.of.get["n"]


class _Counted:
    def __init__(self):
        from pyspark.sql import Observation

        self.of = Observation()


def _json_docs(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("json"))


def read_json(spark: SparkSession, path, pointer: str = "$") -> DataFrame:
    """A JSON document (or one a file) as a table, expanded as ``parse_json`` does; malformed text raises."""
    docs = _json_docs(spark, path)
    if docs.where(F.try_parse_json("json").isNull()).limit(1).count():
        raise ValueError(f"{path} is no JSON")
    return parse_json(docs, "json", pointer, order_by="file").drop("file")


def _ndjson_lines(spark: SparkSession, path) -> DataFrame:
    """Lines that are not blank, with what orders them: the file, where its split begins, and the row's number in that."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")


def read_ndjson(spark: SparkSession, path, *, schema: T.StructType | str | None = None, with_file: bool = False) -> DataFrame:
    """A JSON value a line, blank lines skipped; keys of all objects, in the order first seen, are columns, other values are in ``value``. A malformed line raises. ``with_file`` adds each row's file as ``_file``."""
    if schema is not None:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    lines = _ndjson_lines(spark, path)
    bad = lines.where(F.try_parse_json("value").isNull()).select("file", "value").limit(1).collect()
    if bad:
        raise ValueError(f"a line of {bad[0][0]} is no JSON: {bad[0][1][:80]!r}")
    # Spark sorts what it infers; the order first seen is found by one small aggregation. The keys are the width of the result.
    seen = lines.where(F.ltrim("value").startswith("{")).select("file", "split", "line", F.posexplode(F.json_object_keys("value")).alias("at", "key")).groupBy("key").agg(F.min(F.struct("file", "split", "line", "at")).alias("first")).orderBy("first").select("key")
    keys = [r[0] for r in seen.collect()]
    objects = spark.read.json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_plain")
    kinds = {f.name: f.dataType for f in objects.schema.fields if f.name != "_plain"}
    record = T.StructType([T.StructField(k, kinds.get(k, T.StringType())) for k in keys])
    parsed = lines.select("file", F.when(F.ltrim("value").startswith("{"), F.from_json("value", record)).alias("r"), F.when(~F.ltrim("value").startswith("{"), F.expr("try_variant_get(try_parse_json(value), '$', 'string')")).alias("value"))
    plain = lines.where(~F.ltrim("value").startswith("{")).limit(1).count()
    return parsed.select(*[F.col(f"r.`{k}`") for k in keys], *(["value"] if plain else []), *([F.col("file").alias("_file")] if with_file else []))


def write_json(df: DataFrame, path: str, *, records: bool = True, indent: bool = False, order_by: str | Sequence[str] | None = None) -> int:
    """One JSON array in one part file: of objects with the column names (``col1``... for blank ones), or of arrays, in the order of ``order_by`` (without one, as they come). Gives the number of rows.

    An array is one text, so its rows come together in one task; ``write_ndjson`` is for large tables.
    """
    names = [c if c.strip() else f"col{i + 1}" for i, c in enumerate(df.columns)]
    options = {"ignoreNullFields": "false"}
    if records:
        line = F.to_json(F.struct(*[col(c).alias(n) for c, n in zip(df.columns, names, strict=True)]), options)
    else:
        # Cells of one row differ in type: each is written on its own.
        line = F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(F.regexp_extract(F.to_json(F.struct(col(c).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("null")) for c in df.columns]), F.lit("]"))
        line = F.regexp_replace(line, r"(?<=[\[,])(?=[,\]])", "null")
    gap = ",\n  " if indent else ","
    order = [order_by] if isinstance(order_by, str) else list(order_by or [])
    rows = F.collect_list(F.struct(*[F.col(f"o{i}") for i in range(len(order))], "j"))
    listed = F.transform(F.array_sort(rows) if order else rows, lambda r: r["j"])
    whole = df.select(*[col(c).alias(f"o{i}") for i, c in enumerate(order)], line.alias("j")).agg(F.count("*").alias("n"), F.concat(F.lit("[\n  " if indent else "["), F.array_join(listed, gap), F.lit("\n]" if indent else "]")).alias("value")).persist()
    whole.select("value").coalesce(1).write.mode("overwrite").text(path)
    n = whole.first()["n"]
    whole.unpersist()
    return n


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def list_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False) -> list[str]:
    """Files of a folder that match, by Hadoop's file systems, in the order of their paths without regard to case."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.GlobFilter(glob)
    root = jvm.org.apache.hadoop.fs.Path(folder)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, recursive)
    out = []
    while found.hasNext():
        status = found.next()
        if status.isFile() and not status.isSymlink() and pattern.accept(status.getPath()):
            out.append(status.getPath().toString())
    return sorted(out, key=lambda p: (p.lower(), p))


def _first_line(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    with_codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(where)
    file = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(with_codec.createInputStream(file) if with_codec else file, "UTF-8")).readLine() or ""
    finally:
        file.close()


def read_folder(spark: SparkSession, folder: str, glob: str = "*", *, recursive: bool = False, header: bool = True) -> DataFrame:
    """All files of a folder below each other with their path in ``file``: by column name with a header, by position without. Files that can't be read are left out.

    Files of one kind and header are one scan: the driver reads the first line of each delimited file, as it lists them, and no more.
    """
    groups: dict[tuple, list[str]] = {}
    for path in list_files(spark, folder, glob, recursive):
        kind = next((k for end, k in KINDS.items() if path.lower().endswith(end)), "csv")
        groups.setdefault((kind, _first_line(spark, path) if header and kind in ("csv", "tsv") else ""), []).append(path)
    parts = [df for (kind, _), paths in groups.items() for df in _readable(spark, kind, paths, header)]
    if not parts:
        return spark.createDataFrame([], "file string")
    # A column ``file`` of theirs gives way to the path.
    parts = [df.select(*[to_text(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in df.columns if c not in ("file", "_file")], F.col("_file").alias("file")) for df in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _readable(spark: SparkSession, kind: str, paths: list[str], header: bool) -> list[DataFrame]:
    """What can be read of files of one kind; if a file can't be, the others are halved until it stands alone, and that is said."""
    try:
        if kind in ("csv", "tsv"):
            return [_plain_names(read_csv(spark, paths, delimiter="\t" if kind == "tsv" else ",", header=header, coerce_numeric=False, with_file=True), header)]
        if kind == "ndjson":
            return [read_ndjson(spark, paths, with_file=True)]
        docs = _json_docs(spark, paths)
        if docs.where(F.try_parse_json("json").isNull()).limit(1).count():
            raise ValueError("no JSON")
        return [parse_json(docs.withColumnRenamed("file", "_file"), "json", order_by="_file").drop("position")]
    except Exception as e:  # noqa: BLE001  a file that can't be read is skipped, and said so
        if len(paths) == 1:
            print(f"skipped {paths[0]}: {str(e).splitlines()[0]}")
            return []
        half = len(paths) // 2
        return _readable(spark, kind, paths[:half], header) + _readable(spark, kind, paths[half:], header)


def _plain_names(df: DataFrame, header: bool) -> DataFrame:
    """Repeated header names stay columns of their own: the second ``x`` is ``x_2``."""
    if not header:
        return df
    raw = [f.name for f in df.schema.fields]
    out, seen = [], {}
    for name in raw:
        # Spark names the repeated columns of a header by their position: x0, x3.
        if name == "_file" and len(out) == len(raw) - 1:
            out.append(name)
            break
        base = next((name[: -len(str(i))] for i in [len(out)] if name.endswith(str(i)) and raw.count(name) == 1 and any(r.startswith(name[: -len(str(i))]) and r != name and r[len(name) - len(str(i)) :].isdigit() for r in raw)), name)
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*out)


def file_info(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A row for each path: path, name, extension, exists, is_folder, bytes and the time of the last change (null where it is missing)."""
    jvm = spark._jvm
    rows = []
    for path in paths:
        name = path.rstrip("/").rpartition("/")[2]
        extension = "." + name.rpartition(".")[2] if "." in name else ""
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
            rows.append((path, name, extension, True, status.isDirectory(), status.getLen(), status.getModificationTime()))
        except Exception:  # noqa: BLE001  a fault of one path is that path's
            rows.append((path, name, extension, False, None, None, None))
    df = spark.createDataFrame(rows, "path string, name string, extension string, exists boolean, is_folder boolean, bytes long, changed long")
    return df.withColumn("changed", F.timestamp_millis("changed"))


