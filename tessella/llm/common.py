"""What the training-data operators share: table loading and small column helpers, and the tables of ``tessella.storage``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, scratch, shared_dir, written

__all__ = ["LOWER", "UPPER", "discard", "fresh", "keep_rows", "lower_ascii", "row_key", "scratch", "shared_dir", "spread_text", "table", "written"]

#: The only letters that the operators lower-case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables. Paths go through Spark's readers only, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(ident: Column, text: Column) -> Column:
    """What names a row in joins: its id, and its text's hash so that repeated ids don't mix texts. Never null."""
    return F.struct(ident.alias("id"), F.xxhash64(text).alias("h"))


def spread_text(text: Column, chars: int, parts: int = 20) -> Column:
    """A text of at most ``chars`` characters; of a longer one, pieces spread evenly over the whole, joined by spaces. Null is empty."""
    t, size = F.coalesce(text.cast("string"), F.lit("")), chars // parts
    room = F.length(t) - size
    some = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.substr(t, F.floor(k * room / (parts - 1)).cast("int") + 1, F.lit(size)))
    return F.when(F.length(t) <= chars, t).otherwise(F.array_join(some, " "))


def text_hash(name: str) -> Column:
    """xxhash64 of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("")))


def keep_rows(docs: DataFrame, keep: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose (id, hash of text) stands in ``keep(id, h)``, once each. One shuffle serves the join and the removal of repeats."""
    k, h = fresh(docs, "__k"), fresh(docs, "__h")
    named = lambda i, t: (F.xxhash64(i, t), t)
    own = named(F.col(id_col).cast("long"), text_hash(text_col))
    theirs = named(F.col("id"), F.col("h"))
    mine = docs.withColumn(h, own[1]).withColumn(k, own[0])
    kept = keep.select(theirs[0].alias(k), theirs[1].alias(h))
    return mine.join(kept, [k, h], "left_semi").dropDuplicates([k, h]).drop(k, h).select(*[F.col(f"`{c}`") for c in docs.columns])
