"""Lists of files and patterns: lines or NUL-ended names; and JSON output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import Pattern, PatternError, compile_pattern


#: The characters that Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def files_from(spark: SparkSession, path: str, mode: str = "plain") -> DataFrame:
    """(name). ``plain``: lines, trimmed, comments and empty lines out; ``verbatim``: lines as they are; ``raw``: names ended by NUL, where an empty
    name or a last one without its NUL is an error. Only LF ends a line, a CR before it goes; a byte order mark counts at the front of a file only."""
    whole = spark.read.text(path, wholetext=True)
    if mode == "raw":
        body = F.when(F.col("value").endswith("\0"), F.expr("left(value, length(value) - 1)")).otherwise(F.raise_error(F.lit("the last name does not end with a NUL byte")))
        names = whole.where(F.col("value") != "").select(F.explode(F.split(body, "\0")).alias("name"))
        return names.select(F.when(F.col("name") == "", F.raise_error(F.lit("an empty name"))).otherwise(F.col("name")).cast("string").alias("name"))
    if mode not in ("plain", "verbatim"):
        raise ValueError(mode)
    lines = whole.select(F.explode(F.split(F.regexp_replace("value", "\\A\ufeff", ""), "\n")).alias("line"))
    rows = lines.select(F.regexp_replace("line", r"\r\z", "").alias("name"))
    if mode == "plain":
        rows = rows.select(F.regexp_replace("name", r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "").alias("name")).where(~F.col("name").startswith("#"))
    return rows.where(F.col("name") != "")


def patterns(text: str, fold: bool = False) -> list[Pattern]:
    """A pattern file's contents; errors name the line. Only LF ends a line."""
    out = []
    for k, line in enumerate(text.removeprefix("\ufeff").split("\n"), 1):
        line = line.strip(WHITE)
        if line and not line.startswith("#"):
            try:
                out.append(compile_pattern(line, fold))
            except PatternError as e:
                raise PatternError(f"line {k}: {e}") from None
    return out


def as_json(df: DataFrame) -> DataFrame:
    """(json): each row as an object; nulls left out, binary columns as lower hex."""
    cols = [F.lower(F.hex(f.name)).alias(f.name) if f.dataType.typeName() == "binary" else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols)).alias("json"))
