"""CSV read line by line, so that no malformed line is lost or misread.

The CSV source parses a line with surplus or missing fields, or with an unclosed
quote, into shifted or null columns without a word (an unquoted ``1,234`` becomes
1). Here the source only cuts files into lines and drops each file's header,
having compared it with the first file's. Every line is held against the shape of
a well-formed record of as many fields as the header, in one expression; those
that fit are parsed, the others keep null columns and their raw text in
``MALFORMED``, which the standardising step turns into rejects (``csv_malformed``).

A field is quoted text, in which a quote is doubled, or text without quotes.
A line that holds U+FFFD was not valid text when it was decoded and is malformed.
With ``multi_line`` a quoted field may hold line breaks; a file is then read by
one task, and only the number of fields, the quotes around a field and the
decoding are checked.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plan_alloc.spec import DataError, SchemaError

#: Raw text of a line that could not be parsed; null for well-formed rows.
MALFORMED = "_malformed_line"

#: No line holds this, so the source sees one field a line.
_NO_SEPARATOR = "\x00\x01\x00"
_UNDECODED = "�"
# Possessive, so that a long field is matched in one pass without backtracking.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'


def well_formed(line: Column, fields: int) -> Column:
    """Whether a line is a record of so many comma-separated fields."""
    return line.rlike(f"(?s)\\A{_FIELD}(?:,{_FIELD}){{{fields - 1}}}\\z") & ~line.contains(_UNDECODED)


def header_of(spark: SparkSession, path: str) -> str:
    """The first line of the first file that has one."""
    first = spark.read.text(path).where(F.length("value") > 0).first()
    if first is None:
        raise DataError(f"CSV input '{path}' has no header line.")
    return first["value"]


def column_names(header: str) -> list[str]:
    names = [n.strip() for n in next(csv.reader([header.removeprefix("﻿")], strict=True))]
    if any(not n for n in names):
        raise SchemaError("CSV header has a column without a name.")
    if len(set(names)) != len(names):
        raise SchemaError("CSV header repeats a column name.")
    if MALFORMED in names:
        raise SchemaError(f"CSV header uses the reserved column name '{MALFORMED}'.")
    return names


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every column as text, and ``MALFORMED``."""
    header = header_of(spark, path)
    names = column_names(header)
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {"header": True, "enforceSchema": False, "mode": "PERMISSIVE", "columnPruning": False}
    if multi_line:
        rows = spark.read.options(**options, multiLine=True, escape='"').schema(f"{ddl}, _corrupt_record string").csv(path)
        bad = F.col("_corrupt_record").isNotNull()
        for n in names:
            # A field that still begins with its quote was not closed, or text follows the closing quote.
            bad = bad | F.coalesce(F.col(f"`{n}`").startswith('"') | F.col(f"`{n}`").contains(_UNDECODED), F.lit(False))
        raw = F.coalesce("_corrupt_record", F.concat_ws(",", *[f"`{n}`" for n in names]))
        return rows.select(*[F.when(~bad, F.col(f"`{n}`")).alias(n) for n in names], F.when(bad, raw).alias(MALFORMED))
    one = T.StructType([T.StructField(header, T.StringType()), T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.options(**options, sep=_NO_SEPARATOR, quote="", escape="").schema(one).csv(path).toDF("line", "more")
    # One-element arrays keep the optimizer from copying the match and the parse into every column that reads them.
    lines = lines.select(F.coalesce("more", "line").alias("line")).where("line is not null").select("line", well_formed(F.col("line"), len(names)).alias("fits"))
    parsed = F.when(F.col("fits"), F.from_csv("line", ddl, {"escape": '"', "mode": "PERMISSIVE"}))
    rows = lines.select(F.inline(F.array(F.struct(parsed.alias("row"), F.when(~F.col("fits"), F.col("line")).alias(MALFORMED)))))
    return rows.select(*[F.col("row").getField(n).alias(n) for n in names], MALFORMED)


def drop_malformed(df: DataFrame) -> DataFrame:
    """The well-formed rows, without ``MALFORMED`` (a table that has none is returned as it is)."""
    return df.where(F.col(MALFORMED).isNull()).drop(MALFORMED) if MALFORMED in df.columns else df
