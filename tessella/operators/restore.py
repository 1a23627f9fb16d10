"""Restore as a plan, and random reads: what would be written, and which chunks a byte range needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import PathFilter, prefixes, select


def below(path, subtree: str):
    """Whether ``path`` is the directory ``subtree`` or lies in it, by components."""
    parts, want = F.split(path, "/"), subtree.rstrip("/").split("/")
    return F.slice(parts, 1, len(want)) == F.array(*map(F.lit, want))


def plan(entries: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, subtree: str | None = None) -> DataFrame:
    """(path, kind, size) of what a restore makes: selected entries, and the directories above them."""
    if subtree:
        top = entries.where((F.col("path") == subtree.rstrip("/"))).select("kind").limit(1).collect()
        if not top:
            raise LookupError(f"{subtree} is not in the snapshot")
        if top[0]["kind"] != "dir":
            raise LookupError(f"{subtree} is not a directory")
        entries = entries.where(below(F.col("path"), subtree))
    taken = entries.where(select(F.col("path"), PathFilter(include) if include else None, PathFilter(exclude) if exclude else None))
    above = taken.select(F.explode(prefixes(F.col("path"))).alias("path")).distinct()
    dirs = entries.where(F.col("kind") == "dir").join(above, "path", "left_semi")
    return taken.unionByName(dirs).dropDuplicates(["path"])


def unmatched(entries: DataFrame, include: list[str], exclude: list[str] | None = None) -> DataFrame:
    """(pattern): includes (negated ones aside) that took nothing."""
    f = PathFilter(include)
    taken = entries.where(select(F.col("path"), f, PathFilter(exclude) if exclude else None))
    used = taken.select(F.explode(F.array_distinct(F.flatten(F.transform(prefixes(F.col("path")), f.matching)))).alias("pos")).distinct()
    every = entries.sparkSession.createDataFrame([(k, p.text) for k, p in enumerate(f.patterns) if not p.negated], "pos int, pattern string")
    return every.join(used, "pos", "left_anti").select("pattern")


def offsets(chunks: DataFrame) -> DataFrame:
    """``chunks`` (file, pos, raw_len) with lo and hi: each one's bytes within its file."""
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hi = F.sum("raw_len").over(w)
    return chunks.withColumn("hi", hi.cast("bigint")).withColumn("lo", F.col("hi") - F.col("raw_len"))


def locate(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """For (request, file, start, length): the chunks that hold those bytes, with the part of each. Equality on the file, a range within."""
    c = offsets(chunks)
    end = F.col("start") + F.col("length")
    out = requests.join(c, "file").where((F.col("start") < F.col("hi")) & (end > F.col("lo")) & (F.col("raw_len") > 0))
    a, b = F.greatest("start", "lo") - F.col("lo"), F.least(end, F.col("hi")) - F.col("lo")
    return out.select("request", "file", "pos", a.cast("bigint").alias("from"), b.cast("bigint").alias("to"))


def chunk_lists(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """(file, pos, chunk): direct chunk lists as they are; of indirect ones (``content`` 1) each element names a list (list, chunks) that takes its place."""
    each = entries.select("file", "content", F.posexplode("chunks").alias("at", "id"))
    direct = each.where("content = 0").select("file", "at", F.lit(0).alias("sub"), F.col("id").alias("chunk"))
    inner = lists.select(F.col("list").alias("id"), F.posexplode("chunks").alias("sub", "chunk"))
    both = direct.unionByName(each.where("content <> 0").join(inner, "id").select("file", "at", "sub", "chunk"))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("at", "sub")) - 1).select("file", "pos", "chunk")
